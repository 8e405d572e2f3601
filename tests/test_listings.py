"""Known answers of listing pages, unit resolution and complete cases, with empty and missing values."""

from pyspark.sql import functions as F

from textmill.operators import cases, listings, units

OWN, LEGACY, PUBLISHERS = "example.org", "10.0.0.1", ["Reitoria", "Campus Cuiabá", "Campus Cuiabá - Bela Vista"]
SCHEMA = "page_id long, url string, html string"


def links_of(spark, html, url="https://10.0.0.1/conteudo/noticias/", **more):
    return listings.news_links(spark.createDataFrame([(1, url, html)], SCHEMA), OWN, LEGACY, PUBLISHERS, **more).orderBy("place").collect()


def test_legacy_listing(spark):
    page = """<main><a href="/conteudo/noticia/pesquisa-diagnostica/"> 10 Out - Publicado por Reitoria Instituto realiza
    pesquisa</a><a href="/conteudo/noticias/?page=2">2</a></main>"""
    (found,) = links_of(spark, page)
    assert (found["address"], found["kind"], found["date_label"], found["publisher"], found["title"]) == ("https://10.0.0.1/conteudo/noticia/pesquisa-diagnostica/", "legacy_article", "10 Out", "Reitoria", "Instituto realiza pesquisa")


def test_article_box(spark):
    page = """<article class="post"><h2>Titulo da noticia</h2><a href="https://www.example.org/blog/titulo-da-noticia/">ler</a>
    <p>12/03/2024</p><p>Resumo</p><span class="entry-date">12 de março</span><img src="/a.png"></article>
    <nav><a href="https://example.org/blog/categoria/noticias/page/2/">2</a><a href="/blog/menu/">x</a></nav>"""
    (found,) = links_of(spark, page, "https://example.org/blog/categoria/noticias/")
    assert (found["kind"], found["title"], found["summary"], found["date_label"], found["image"], found["relative_href"]) == ("current_wordpress_article", "Titulo da noticia", "Resumo", "12 de março", "https://example.org/a.png", False)


def test_most_and_empty_pages(spark):
    page = "".join(f"<div><a href='/blog/n{i % 3}/'>n{i}</a></div>" for i in range(6))
    assert [r["address"][-3:] for r in links_of(spark, page, "http://example.org/", most=2)] == ["n0/", "n1/"]
    assert links_of(spark, None) == [] and links_of(spark, "") == [] and links_of(spark, "<a href='/blog/x/'>x</a>", None) == []


def test_labels(spark):
    labels = [("3 Mai - publicado por campus cuiaba - bela vista Abre", "Abre", "Campus Cuiabá - Bela Vista"), ("3 Mai - Publicado por Campus Novo do Sul fala", "do Sul fala".replace("do ", "", 1), "Campus Novo do"), ("Sem data", "Sem data", ""), (None, "", "")]
    rows = spark.createDataFrame([(x,) for x, *_ in labels], "v string").select(listings.split_label(F.col("v"), PUBLISHERS).alias("x")).collect()
    assert [(r["x"]["title"], r["x"]["publisher"]) for r in rows] == [tuple(x[1:]) for x in labels]


def test_article_units(spark):
    aliases = spark.createDataFrame([("campus caceres", "cas"), ("bela vista", "blv"), ("campus lucas do rio verde", "lrv")], "alias_key string, code string")
    fragments = spark.createDataFrame([("caceres", "cas", 1)], "fragment string, code string, ord int")
    rows = [
        (1, "Campus Cáceres", None, "", None), (2, "Bela Vista", "Campus Caceres", "", None), (3, "Campus Cáceres Inscrições", "", "", None), (4, "Campus Avançado de", "", "Lucas do Rio Verde inicia", None),
        (5, "", None, "", "svc"), (6, "Campus Avançado de", "", "", None), (7, None, None, None, None), (8, "Campus Avançado de", "Bela  Vista", "", "svc"), (9, "Bela Vistas", "", "", None),
    ]
    articles = spark.createDataFrame(rows, "id long, publisher string, campus string, title string, home string")
    found = units.article_units(articles, "id", ["publisher", "campus"], ["title"], aliases, fragments, "campus avancado de", [("lucas do rio verde", "lrv"), ("sinop", "snp")], "home")
    got = {r["id"]: (r["code"], r["status"]) for r in found.collect()}
    assert got == {
        1: ("cas", "exact_match"), 2: ("blv", "exact_match"), 3: ("cas", "rule_match"), 4: ("lrv", "rule_match"), 5: ("svc", "rule_match"), 6: (None, "needs_review"), 7: (None, "unknown"), 8: ("blv", "exact_match"),
        9: ("blv", "fuzzy_match"),
    }
    assert units.article_units(articles.limit(0), "id", ["publisher"], ["title"], aliases, fragments, "campus avancado de", [("sinop", "snp")]).count() == 0


def test_incomplete_cases(spark):
    every = ["a", "b"]
    outputs = spark.createDataFrame([(1, "a", "ok", None), (1, "b", "ok", ""), (2, "a", "ok", ""), (2, "a", "ok", ""), (3, "a", None, "bad"), (3, "b", "ok", "")], "case_id long, configuration string, status string, parse_error string")
    scores = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a"), (3, "b"), (4, "a")], "case_id long, configuration string")
    found = sorted(map(tuple, cases.incomplete(outputs, scores, every).collect()))
    assert found == [(2, "outputs"), (2, "scores"), (3, "not ok"), (3, "parse error"), (4, "outputs"), (4, "scores")]


def test_subtitle_and_publisher(spark):
    from textmill.operators import html

    body = "<main><h1>Title</h1><p class='lead'>Opening words of it</p><p class='subtitulo'>Below the title</p><p>Publicado por: Unit One / 2024</p><p>" + "Opening words of it " * 6 + "</p></main>"
    pages = [(1, "http://example.org/a", "<meta name='description' content='Title'>" + body), (2, "http://example.org/b", "<meta property='og:description' content=' Said  first '>" + body), (3, "http://example.org/c", None)]
    found = {r["page_id"]: r for r in html.articles(spark.createDataFrame(pages, SCHEMA)).collect()}
    assert found[2]["subtitle"] == "Said first" and found[3]["subtitle"] == ""
    assert found[1]["publisher"] == "Unit One" and found[1]["subtitle"] == ""  # both stand in the head of the body
    rows = spark.createDataFrame([(["", "T", "in body", "new"], "T", "it is in body"), ([None, "T"], "T", None), (None, "T", "x")], "c array<string>, t string, b string")
    assert [r["s"] for r in rows.select(html.subtitle(F.col("c"), F.col("t"), F.col("b")).alias("s")).collect()] == ["new", "", ""]
