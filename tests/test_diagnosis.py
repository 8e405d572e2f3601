"""Diagnosis of sources: families of links, paging, articles, recommendation."""

from textmill.operators import diagnosis, listings
from textmill.operators.old_portal import Portal

PORTAL, PUBLISHERS = Portal("inst"), ["Reitoria"]
FETCHED = "url string, final_url string, status int, html string"


def kinds():
    return diagnosis.families("example.org", "10.0.0.1", "old.example.org")


def union(spark, html, url="http://a.old.example.org/noticias/"):
    rows = listings.anchor_rows(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"))
    return [tuple(r) for r in diagnosis.link_union(rows, kinds(), PUBLISHERS).orderBy("place").select("place", "family", "kind", "normalized", "title").collect()]


def test_first_family_wins(spark):
    page = """<ul><li><a href="/noticias/">all</a></li><li><a href="/noticias/17/#x">Dezessete</a> 3 de maio</li><li><a href="/noticias/17/?utm_source=a">again</a></li>
    <li><h3>Um titulo</h3><a href="/noticia/um-titulo/">leia</a></li><li><a href="http://b.old.example.org/noticias/9/">Nove</a></li><li><a href="http://other.org/noticias/3/">out</a></li><li><a href="/noticias/file.pdf">file</a></li></ul>
    <nav><a href="/noticias/5/">Cinco</a><a href="/noticia/um-titulo/">again</a></nav>"""
    found = union(spark, page)
    assert [(f[1], f[2], f[3][-12:]) for f in found] == [(0, "article_like_path", "noticias/17/"), (0, "article_like_path", "a/um-titulo/"), (0, "article_like_path", "/noticias/9/"), (1, "numeric_news", "/noticias/5/")]
    assert [f[0] for f in found] == [1, 2, 3, 4] and found[1][4] == "Um titulo" and found[3][4] == "Cinco"
    assert union(spark, None) == union(spark, "") == union(spark, "<a>no address</a>") == []


def listing(*ids):
    return "<title> News </title>" + "".join(f"<div><a href='/noticias/{i}/'>Artigo {i}</a></div>" for i in ids) + "<a href='?page=2'>2</a><a href='?page=3'>3</a>"


def test_hosts(spark):
    a, b, c, d = (f"http://{h}.old.example.org/noticias/" for h in "abcd")
    article = "<body><h1>Artigo 1</h1><p>3/05/2020</p><p>corpo</p></body>"
    fetched = [
        (a, a, 200, listing(1, 2)), (a.replace("http:", "https:"), None, 500, ""), (a + "?page=2", None, 200, listing(3)), (a + "page/2/", None, 200, listing(1, 2)), (a + "?page=10", None, 404, listing(7)), (a + "1/", None, 200, article), (a + "2/", None, 404, article),
        (b, b, 200, listing()), (b + "?page=2", b, 200, listing(1)), (b + "?page=2", b, 200, ""), (b + "1/", b, 200, "<p>other</p>"), (c, c, 200, None),
    ]
    tested = spark.createDataFrame([(u,) for u in (a, a, a.replace("http:", "https:"), b, c, d)], "url string")
    found = diagnosis.diagnose(tested, spark.createDataFrame(fetched, FETCHED), kinds(), PUBLISHERS, PORTAL)
    hosts = {r["host"][0]: r.asDict() for r in found.hosts.collect()}
    pick = lambda h: tuple(hosts[h][k] for k in ("tested", "opened", "candidates", "has_news", "paging_works", "articles_tested", "extractable", "recommended"))
    assert pick("a") == (2, True, 2, True, True, 2, 1, True) and hosts["a"]["best_url"] == a
    assert pick("b") == (1, True, 0, True, True, 1, 0, False)
    assert pick("c") == pick("d") == (1, False, 0, False, False, 0, 0, False)
    works = sorted((r["host"][0], r["style"], r["page"]) for r in found.paging.where("works").collect())
    assert works == [("a", "query_page", 2), ("b", "query_page", 2)] and found.paging.count() == 18
    assert [r["style"] for r in found.paging.where("same_as_first").collect()] == ["path_page"]
    (read,) = found.articles.where("extractable").collect()
    assert (read["date_label"], read["words"], read["preview"]) == ("3/05/2020", 4, "3/05/2020\n\ncorpo")
    (first,) = found.listings.where(found.listings.url == a).collect()
    assert (first["title"], first["kinds"], first["paths"], first["paging_links"]) == ("News", {"article_like_path": 2}, {"/noticias/{id}/": 2}, {"query_page": 2})
    assert tuple(found.summary().first()) == (4, 2, 2, 2, 1)


def test_empty_tables(spark):
    found = diagnosis.diagnose(spark.createDataFrame([], "url string"), spark.createDataFrame([], FETCHED), kinds(), PUBLISHERS, PORTAL)
    assert found.hosts.count() == found.listings.count() == 0 and tuple(found.summary().first()) == (0, 0, 0, 0, 0)
