"""Pages of an old portal: the node of the article, its lines, and the fields that a diagnosis reads."""

import random

from pyspark.sql import functions as F

from textmill.operators import html, listings, old_portal
from textmill.operators.old_portal import Portal

PORTAL = Portal("inst", "instituto de ensino")
WORDS = "palavras do corpo da noticia que segue "
PAGE = f"""<html><head><title>Portal</title><script>var a = 1;</script></head><body><div class="menu">Institucional <a href="/x">Sistemas</a></div>
<div id="barra_central"><div>Início</div><p>&gt;&gt; Notícias</p><ul class="itens_noticia"><li class="atual"><a href="#">Edital aberto em Cuiabá</a></li></ul>
<p>{WORDS * 2}</p><p>Publicado em 3 de maio de 2019</p><p>Ascom / Campus Bela Vista</p><p>{WORDS * 3}</p>
<h3>Documentos</h3><ul><li><a href="/get_file/1">arquivo um</a></li><li><a href="/b.html">sem nada</a></li></ul><p>depois</p></div><div>Cursos</div></body></html>"""


def test_article_of_the_central_bar(spark):
    rows = [(1, PAGE, "Edital aberto"), (2, None, "Listed"), (3, "", None), (4, "<p>a</p>", ""), (5, PAGE, None)]
    found = {r["page_id"]: r for r in old_portal.articles(spark.createDataFrame(rows, "page_id long, html string, listed_title string"), PORTAL).collect()}
    for i in (1, 5):
        r = found[i]
        assert (r["title"], r["author"], r["publisher"], r["date_label"], r["documents"], r["node"]) == ("Edital aberto em Cuiabá", "Ascom / Campus Bela Vista", "Campus Bela Vista", "3 de maio de 2019", 2, "div#barra_central")  # the title links to an edital
        assert r["body"].split("\n\n") == [(WORDS * 2).strip(), "Publicado em 3 de maio de 2019", (WORDS * 3).strip()]
    assert (found[2]["title"], found[2]["body"], found[2]["words"], found[2]["node"]) == ("Listed", "", 0, "")
    assert (found[3]["title"], found[3]["body"], found[4]["node"]) == ("", "", "")


def test_fallback_to_lines_and_bad_titles(spark):
    page = f"<div class='corpo'><h1>Instituto de Ensino</h1><span>Aviso geral</span><span>{WORDS * 15}</span><span>Comunicação Inst / Sede</span><p>curto</p><span>anexo.pdf</span><span>nunca</span></div>"
    (r,) = old_portal.articles(spark.createDataFrame([(1, page, "Aviso geral")], "page_id long, html string, listed_title string"), PORTAL).collect()
    assert r["title"] == "Aviso geral" and r["body"] == (WORDS * 15).strip() + "\n\ncurto" and r["node"] == "div.corpo"


def test_line_scan(spark):
    cases = [
        (["Menu", "O Título", "corpo um", "Ascom Inst", "dia 3/05/2019", "Assessoria dois", "Documentos", "fim"], "o título!", ("3/05/2019", "Ascom Inst", "", 8, "corpo um\n\ndia 3/05/2019\n\nAssessoria dois")),
        (["Veja: O Título de novo", "Inst / Campus Norte", "12 maio", "Edital 4"], "o título", ("12 maio", "Inst / Campus Norte", "Campus Norte", 2, "12 maio")),
        (["nada", "1 de abril"], "o título", ("1 de abril", "", "", 0, "")),
        (["O Título"], "o título", ("", "", "", 0, "")), ([], "x", ("", "", "", 0, "")), (["a"], "", ("", "", "", 0, "")), (["a"], None, ("", "", "", 0, "")),
        (["x", "Site desativado inst / ascom", "Cursos", "b"], "x", ("", "", "", 4, "Site desativado inst / ascom")),
    ]
    rows = spark.createDataFrame([(c[0], c[1]) for c in cases], "l array<string>, t string").select(old_portal.line_scan(F.col("l"), F.col("t"), PORTAL).alias("x")).collect()
    assert [tuple(r["x"]) for r in rows] == [c[2] for c in cases]


def test_scores_equal_walks_of_every_node():
    pick = random.Random(4)

    def nested(depth):
        parts = [pick.choice(["", "sistemas", "titulo da casa", "3 de maio", "12/03/2020", "<p>um dois</p>", "<a href='/x.pdf'>ver</a>", "inicio", "7 dias", "a < b"])]
        for _ in range(pick.randint(0, 3) if depth else 0):
            names = pick.choice(["class='content'", "id='corpo'", "class='menu'", "", "class='itens_noticia'"])
            parts.append(f"<div {names}>{nested(depth - 1)}</div>" + pick.choice(["", "fim do titulo da casa"]))
        return "".join(parts)

    import re

    for _ in range(60):
        page = old_portal.layout(nested(5))
        found = old_portal.scores(page, page.nodes, "Título da casa", "instituto")
        for n, score in zip(page.nodes, found):
            inside = page.below(n)
            said = page.text(n)
            key = old_portal.key_of(said)
            names = " ".join(n.attrs.values())
            want = (0 if key in old_portal.EMPTY_KEYS else len(said)) + 90 * sum(c.tag == "p" for c in inside) + 35 * sum(c.tag == "a" for c in inside)
            want += 350 * ("titulo da casa" in key) + 120 * any(re.search(p, said) for p in old_portal.ANY_DATE) + 450 * ("itens_noticia" in names) + 120 * ("corpo" in names)
            want -= 1000 * ("menu" in names) + 90 * sum(p in key for p in old_portal.MENU_PHRASES)
            assert score == want, said


def test_blocks_and_deep_pages():
    assert old_portal.blocks_of(None) == old_portal.blocks_of("") == []
    page = "".join(f"<div class='content' id='b{i}'>{'x' * (i % 30)}<p>y</p></div>" for i in range(60))
    found = old_portal.blocks_of(page)
    assert len(found) == old_portal.BEST and [b["id"] for b in found[:3]] == ["b29", "b59", "b28"] and found[0]["paragraphs"] == 1 and found[0]["chars"] == 31
    deep = old_portal.layout("<div class='content'>" * 5000 + "text")
    assert len(deep.below(deep.nodes[0])) == 5000 and html.matches(old_portal.candidates(deep)[0], ".content") and deep.text(deep.nodes[0]) == "text"


def test_trees_are_freed_and_lines_are_those_of_the_layout():
    import gc

    pages = [None, "", "<p>one\n two<script>x</script><p>three <b>four</b> &amp; five<svg><p>six</p></svg>" * 20, PAGE]
    gc.collect()
    gc.disable()
    try:
        for p in pages:
            assert old_portal.lines_of(p) == old_portal.layout(p or "").lines
        gc.collect()
        for p in pages:
            old_portal.lines_of(p), old_portal.parse(p, "", ""), old_portal.blocks_of(p), listings.anchors_of(p)
        assert not [x for x in gc.get_objects() if isinstance(x, html.Node)]
    finally:
        gc.enable()


def test_anchors_of_one_large_box_come_in_portions(monkeypatch):
    monkeypatch.setattr(listings, "PORTION", 1000)
    found = listings.anchors_of("<li>" + "<a href='/x'>some words</a> " * 50 + "</li>")
    parts = list(listings._portions((0, i, a) for i, a in enumerate(found)))
    assert len(parts) == 25 and [i for p in parts for _, i, _ in p] == list(range(50))


def test_keys_of_lines_are_made_once(spark):
    """The plan of a scan holds one key of lines, not one for each test of a line."""
    plan = spark.createDataFrame([(["a"], "a")], "l array<string>, t string").select(old_portal.line_scan(F.col("l"), F.col("t"), PORTAL).alias("s"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[^a-z0-9À-ÿ]+") == 2
