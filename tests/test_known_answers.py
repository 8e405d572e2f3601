"""Known answers of single operators."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.functions import dates, text, urls, values
from textmill.operators import cases, dedupe, graph, html, profile, sampling, units
from textmill.sources import readers, sinks


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "date", "time"),
    [
        ("22 de Outubro de 2025 às 13:28", "2025-10-22", "13:28"), ("2026-05-31T13:12:32+00:00", "2026-05-31", "13:12"), ("3/7/21 9:05 pm", "2021-07-03", "21:05"), ("2024-02-30", "", "00:00"), ("31/02/2024", "", ""),
        ("10 Out", "", ""), ("March 3, 2020", "2020-03-03", ""), ("12 foo, May 3, 2020", "", ""), ("2024-01-05", "2024-01-05", "00:00"), ("", "", ""), ("12:00 am 1/1/2020", "2020-01-01", "00:00"),
    ],
)
def test_dates(spark, raw, date, time):
    found = one(spark, raw, dates.parse_when)
    assert (found["date"], found["time"]) == (date, time)


@pytest.mark.parametrize(
    ("url", "normal"),
    [
        ("HTTPS://200.129.244.212/conteudo/noticia/exemplo/?utm_source=x&ok=1#top", "https://200.129.244.212/conteudo/noticia/exemplo/?ok=1"), ("http://User@Host.ORG:8080//a//b/../c?x&ref=1", "http://host.org:8080/a/c?x="),
        ("https://h.org", "https://h.org/"), ("https://h.org/a/./b/;p", "https://h.org/a/b/"),
    ],
)
def test_urls(spark, url, normal):
    assert one(spark, url, urls.normalize_url) == normal


def test_link_resolution(spark):
    base = F.lit("https://h.org/a/b.html")
    for href, want in {"/x.pdf": "https://h.org/x.pdf", "c/d": "https://h.org/a/c/d", "../e": "https://h.org/e", "//o.org/z": "https://o.org/z", "#t": None, "mailto:a@b": None, "?p=2": "https://h.org/a/b.html?p=2"}.items():
        assert one(spark, href, lambda v: urls.resolve(v, base)) == want, href


def test_link_types(spark):
    for url, want in {"https://forms.gle/x": "form", "https://drive.google.com/y": "drive", "https://h.org/a.PDF": "document", "https://youtu.be/1": "video", "https://h.org/edital-3": "edital", "https://w.h.org/n": "internal", "https://o.org/": "external"}.items():
        assert one(spark, url, lambda v: urls.link_type(v, F.lit(""), "h.org")) == want, url


def test_text(spark):
    assert one(spark, " a  b\t\n\n\n\nc ", text.normalize_space) == "a b \n\nc" or one(spark, " a  b\n\n\n\nc ", text.normalize_space) == "a b\n\nc"
    assert one(spark, "Ação — Céu_1!", text.text_key) == "acao ceu_1"
    assert one(spark, "SeleÃ§Ã£o", text.repair_mojibake) == "Seleção"
    assert one(spark, "plain Ã", text.repair_mojibake) == "plain Ã"
    assert one(spark, "One. Two! three? x", text.sentences) == ["One.", "Two!", "three?", "x"]
    assert one(spark, None, text.text_hash) == ""
    assert one(spark, "Maria foi. MARIA veio (a+b)", lambda v: text.redact(v, F.array(F.lit("maria"), F.lit("(a+b)")), "[X]")) == "[X] foi. [X] veio [X]"
    paragraphs = F.array(*map(F.lit, ["Menu", "um dois tres quatro cinco", "um dois tres quatro cinco", "x", "Redes Sociais aqui"]))
    assert one(spark, "", lambda v: text.clean_body(paragraphs)) == "um dois tres quatro cinco\n\nx"
    assert one(spark, "", lambda v: text.reading_time(F.lit(500))) == 2 and one(spark, "", lambda v: text.reading_time(F.lit(0))) == 0


def test_values(spark):
    assert one(spark, "3.9", values.safe_int) == 3 and one(spark, "x", lambda v: values.safe_int(v, 7)) == 7
    assert one(spark, " SIM ", values.truthy) is True and one(spark, None, values.truthy) is False
    assert one(spark, '["a","b"]', values.json_list) == ["a", "b"] and one(spark, "no", values.json_list) == []
    assert one(spark, 'so: {"a": 1} end', lambda v: F.try_variant_get(values.json_object(v), "$.a", "int")) == 1
    assert one(spark, "O que", values.field_name) == "what" and one(spark, "zzz", values.field_name) is None
    assert one(spark, "", lambda v: values.ndcg(F.array(F.lit(0), F.lit(2)), F.array(F.lit(2), F.lit(0)))) == pytest.approx(0.6309, abs=1e-4)


def test_similarity():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diagonal = 0
            for j, y in enumerate(b):
                diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    pick = random.Random(1)
    for _ in range(200):
        a, b = ("".join(pick.choices("abc", k=pick.randint(0, 12))) for _ in range(2))
        assert dedupe.common_subsequence(a, b) == plain(a, b)
    assert dedupe.indel("abcd", "abcd") == 100 and dedupe.indel("", "") == 100 and dedupe.indel("ab", "cd") == 0
    assert units.weighted_ratio("campus caceres", "caceres campus") == 95 and units.weighted_ratio("", "a") == 0


def test_components_of_path_and_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100)]
    roots = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {roots[i] for i in range(1, 61)} == {1} and {roots[i] for i in (100, 101, 102)} == {100}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_samples(spark):
    rows = spark.createDataFrame([(i, f"g{i % 6}") for i in range(48)], "id long, label string")
    pilot = rows.where("id < 2")
    left = rows.join(pilot, "id", "left_anti")
    first = sampling.equal_groups(left, "label", 5, 42, "id").collect()
    assert len(first) == 30 and set(Counter(r["label"] for r in first).values()) == {5} and not {0, 1} & {r["id"] for r in first}
    assert first == sampling.equal_groups(left.repartition(5), "label", 5, 42, "id").collect() or {r["id"] for r in first} == {r["id"] for r in sampling.equal_groups(left.repartition(5), "label", 5, 42, "id").collect()}
    with pytest.raises(Exception, match="g0 requires 9 rows, found 8"):
        sampling.equal_groups(rows, "label", 9, 42, "id").collect()
    ids = sampling.numbered(rows, "art", ["id"], "name").orderBy("id").collect()
    assert [r["name"] for r in ids] == [f"art_{i + 1:08d}" for i in range(48)]


def test_parallelism(spark):
    def chosen(rpm2, vram, failures):
        runs = spark.createDataFrame([(1, 1.0, 7000.0, 0), (2, rpm2, vram, failures)], "parallelism int, rpm double, vram double, failures int")
        return profile.select_parallelism(runs).first()["parallelism"]

    assert [chosen(1.16, 7750.0, 0), chosen(1.16, 7900.0, 0), chosen(1.16, 7750.0, 1), chosen(1.14, 7750.0, 0)] == [2, 1, 1, 1]


PAGE = """<html><head><title>T - Site</title><meta property="article:published_time" content="2026-05-31T13:12:32+00:00"><meta name="author" content="Thiago Almeida"><meta property="og:image" content="/capa.jpg"><link rel="canonical" href="/n/1/"></head>
<body><nav><a href="/menu">Menu</a></nav><main><h1>Titulo da noticia</h1><div class="content"><p>Primeiro paragrafo com varias palavras para o lead do texto.<p>Segundo paragrafo com mais texto, para passar do limite de vinte palavras no corpo.
<a href="/arquivo.pdf">Arquivo</a><figure><img src="foto.jpg" alt="Foto"><figcaption>Legenda</figcaption></figure></div></main><script>var x = "</p>";</script></body></html>"""


def test_article(spark):
    pages = spark.createDataFrame([(1, "https://h.org/n/1/?utm_source=a", PAGE), (2, "https://h.org/n/2/", None), (3, "https://h.org/n/3/", "<p>x")], "page_id long, url string, html string")
    found = html.articles(pages)
    rows = {r["page_id"]: r for r in found.collect()}
    a = rows[1]
    assert (a["title"], a["author"], a["date"], a["time"], a["status"]) == ("Titulo da noticia", "Thiago Almeida", "2026-05-31", "13:12", "collected")
    assert a["canonical_url"] == "https://h.org/n/1/" and a["lead"].startswith("Primeiro") and "Menu" not in a["body"]
    assert rows[2]["status"] == "needs_review" and rows[3]["message"] == "missing title, short body"
    media = html.media_of(found).orderBy("position").collect()
    assert [(m["kind"], m["normalized"], m["caption"]) for m in media] == [("featured", "https://h.org/capa.jpg", ""), ("inline", "https://h.org/n/1/foto.jpg", "Legenda")]
    links = {r["normalized"]: r["link_type"] for r in html.links_of(found, "h.org").collect()}
    assert links["https://h.org/arquivo.pdf"] == "document" and links["https://h.org/menu"] == "internal"


def test_masked_fields_are_computed_once(spark):
    truth = cases.ground_truth(who=F.upper(F.concat(F.lit("w"), "id")), when=F.lit("2024"), where=F.lit("w"))
    rows = cases.masked(spark.range(8).select(F.col("id"), truth.alias("truth"), F.lit(2).alias("depth")), "truth", 42, "id", "depth")
    plan = rows.select("removed_fields", "available")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1 and plan.count("upper(") == 1


def test_masking(spark):
    truth = cases.ground_truth(who=F.lit("Ana"), what=F.lit("Projeto X"), when=F.lit("2026-01-02"), where=F.lit("ana"), unit=F.lit("Ana"))
    row = cases.masked(spark.range(8).select(F.col("id"), truth.alias("truth"), F.lit(2).alias("depth")), "truth", 42, "id", "depth").withColumn("pitch", cases.pitch(F.col("available"))).collect()
    for r in row:
        assert "what" not in r["removed_fields"] and r["mask_depth"] == len(r["removed_fields"]) >= 2
        assert not {"who", "where", "unit"} & set(r["removed_fields"]) or {"who", "where", "unit"} <= set(r["removed_fields"])
        assert all(r["truth"][f] not in r["pitch"] for f in r["removed_fields"])
    p = spark.range(1).select(cases.pitch(F.create_map(F.lit("what"), F.lit("Projeto X"), F.lit("when"), F.lit("2026-01-02"))).alias("p")).withColumn("f", cases.extract(F.col("p"))).first()
    assert p["p"] == f"Assunto: Projeto X. Data confirmada: 2026-01-02. {cases.ENDING}" and p["f"] == {"what": "Projeto X", "when": "2026-01-02"}


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2], "x | y"), ("b", None, None)], "k string, l array<int>, t string")
    sinks.jsonl(rows, str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j"), rows.schema).count() == 2
    assert readers.jsonl(spark, str(tmp_path / "none"), rows.schema, missing_ok=True).count() == 0
    sinks.csv(rows, str(tmp_path / "c"), ["k", "l", "more"])
    assert {(r["k"], r["l"]) for r in readers.csv(spark, str(tmp_path / "c")).collect()} == {("a", "[1,2]"), ("b", None)}
    assert "x / y" in sinks.markdown(rows) and r"\_" in sinks.latex_escape("a_b")
    (tmp_path / "bom.csv").write_text("﻿id,v\n1,2\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "bom.csv")).columns == ["id", "v"]
    lines = spark.createDataFrame([("2024-01-01, 97 %, 7650.0 MiB, 8188 MiB, 74, 82.0 W",), ("short, 1",)], "value string")
    assert [tuple(r) for r in readers.telemetry(lines).collect()] == [(97.0, 7650.0, 8188.0, 74.0, 82.0)]


def test_fetching(spark):
    def get(url, timeout):
        if "bad" in url:
            raise OSError("down")
        return (200, url + "final", "<p>") if "ok" in url else (404, url, "")

    targets = spark.createDataFrame([("http://ok/",), ("http://bad/",), ("http://no/",)], "url string")
    found = {r["request_url"]: r for r in readers.fetch(targets, get, readers.FetchPolicy(delay=0), pause=lambda s: None).collect()}
    assert found["http://ok/"]["success"] and found["http://bad/"]["retry_count"] == 2 and found["http://no/"]["status_code"] == 404
    with pytest.raises(ValueError):
        readers.select_sources(spark, ["nope"], {}, [])
    assert [r["source_id"] for r in readers.select_sources(spark, ["g", "a"], {"g": ["b", "a"]}, ["a", "b"]).orderBy("position").collect()] == ["b", "a"]


def test_partial_ratio_is_the_best_window():
    pick = random.Random(4)
    for _ in range(300):
        a, b = ("".join(pick.choices("abc d", k=pick.randint(1, 14))) for _ in range(2))
        short, long = sorted((a, b), key=len)
        assert units.partial_ratio(a, b) == max(units.ratio(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def test_settled_labels_are_those_of_all_matches_without_comparing(spark):
    labels = spark.createDataFrame([("France",), ("Campus france",), ("FRANCE - x",), ("Frnce",), ("zz",), ("",), (None,)], "label string")
    aliases = spark.createDataFrame([("france", "6"), ("campus france", "6"), ("peru", "17")], "alias_key string, code string")
    fragments = spark.createDataFrame([("france", "6", 6), ("peru", "17", 17)], "fragment string, code string, ord int")
    settled = units.settled_units(labels, "label", aliases, fragments)
    whole = units.match_units(labels, "label", aliases, fragments)
    assert "label_score" not in settled._jdf.queryExecution().toString()
    assert {tuple(r) for r in settled.collect()} == {tuple(r) for r in whole.where("status in ('exact_match', 'rule_match')").select("label", "code", "status").collect()} == {("France", "6", "exact_match"), ("Campus france", "6", "exact_match"), ("FRANCE - x", "6", "rule_match")}
