"""Listing pages: labels, candidates with what stands around them, discovery; units of articles; complete cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cases, listings, units
from .registry import query, read

PUBLISHERS = ["Unit One", "Unit One North", "Rectory"]
_SAID = ["Unit One opens", "unit one north Opens again", "Rectory", "campus Far Away tells all", "campus", "Nobody tells"]
_SPLIT = [("opens", "Unit One"), ("Opens again", "Unit One North"), ("Rectory", "Rectory"), ("tells all", "campus Far Away"), ("campus", ""), ("Nobody tells", "")]


@query(f"""WITH l AS (SELECT page_id, page_id % 7 AS k, page_id % 28 + 1 AS d FROM pages), s(k, title, publisher) AS (VALUES {', '.join(f"({i}, '{t}', '{p}')" for i, (t, p) in enumerate(_SPLIT))})
SELECT page_id, coalesce(title, 'No date ' || page_id) AS title, CASE WHEN title IS NULL THEN '' ELSE d || ' Out' END AS date_label, coalesce(publisher, '') AS publisher FROM l LEFT JOIN s USING (k)""")
def h6_listing_label(spark, sf_dir):
    page = F.col("page_id")
    said = F.get(F.lit(_SAID), (page % 7).cast("int"))
    label = F.when(said.isNull(), F.concat(F.lit("No  date "), page)).otherwise(F.concat(F.lit(" "), page % 28 + 1, F.lit("  Out - publicado por "), said, F.lit(" ")))
    return read(spark, sf_dir, "pages").select("page_id", listings.split_label(label, PUBLISHERS).alias("x")).select("page_id", "x.*")


_PAGE = [
    "<html><body><nav><a href='/blog/nav-link/'>Never taken, as it navigates</a></nav><ul class='items'><li><a href='/blog/story-", "#top'>Story ", "</a></li>",
    "<li><h3>The story ", "</h3><a href='/blog/story-", "'>more</a><p>3 de maio</p><p>What it tells</p><time datetime='2024-05-03'></time><img data-src='/i/a.png'></li></ul>",
    "<main><a href='/conteudo/noticia/old-", "/'>10 Out - Publicado por Rectory An old one</a><a href='/blog/file.pdf'>A file, which is no news at all</a><a href='mailto:x@example.org'>mail</a></main></body></html>",
]


def listing_pages(spark, sf_dir):
    """A listing page for each page: navigation, one address twice, an old label, a file."""
    page = F.col("page_id").cast("string")
    parts = [F.lit(_PAGE[0]), page, F.lit(_PAGE[1]), page, F.lit(_PAGE[2] + _PAGE[3]), page, F.lit(_PAGE[4]), page, F.lit(_PAGE[5] + _PAGE[6]), F.floor(F.col("page_id") / 2).cast("string"), F.lit(_PAGE[7])]
    return read(spark, sf_dir, "pages").select("page_id", F.lit("http://example.org/list/").alias("url"), F.concat(*parts).alias("html"))


def listed(spark, sf_dir, most=None):
    return listings.news_links(listing_pages(spark, sf_dir), "example.org", "10.0.0.1", PUBLISHERS, most=most)


LISTED = """listed AS (SELECT page_id, 1 AS place, 'http://example.org/blog/story-' || page_id AS address, '/blog/story-' || page_id AS href, 'current_wordpress_article' AS kind, 'more' AS label, 'The story ' || page_id AS title, 'What it tells' AS summary, '2024-05-03' AS date_label, '' AS publisher, 'http://example.org/i/a.png' AS image, true AS relative_href FROM pages
UNION ALL SELECT page_id, 2, 'http://example.org/conteudo/noticia/old-' || (page_id // 2) || '/', '/conteudo/noticia/old-' || (page_id // 2) || '/', 'legacy_article', '10 Out - Publicado por Rectory An old one', 'An old one', '', '10 Out', 'Rectory', '', true FROM pages)"""


@query(f"WITH {LISTED} SELECT * FROM listed")
def h2_listing_links(spark, sf_dir):
    """Of two anchors of one address the one that fills more fields."""
    return listed(spark, sf_dir)


@query(f"WITH {LISTED} SELECT page_id, count(*) AS n FROM listed GROUP BY 1")
def h4_news_link_count(spark, sf_dir):
    return listed(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"WITH {LISTED}, s AS (SELECT *, page_id % 10 AS source FROM listed) SELECT address AS normalized, min(source) AS source, arg_min(page_id, source * 1000000000 + page_id) AS page_id, min(address) AS address, min(title) AS title, min(kind) AS kind, count(*) - 1 AS alternatives FROM s GROUP BY 1")
def c6_discover(spark, sf_dir):
    """News addresses over all listing pages, each once."""
    return listings.discover(listed(spark, sf_dir).withColumn("source", F.col("page_id") % 10), "source", "page_id")


_UNITS = """n AS (SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS k, n_nationkey::VARCHAR AS code, n_name FROM nation),
c AS (SELECT c_custkey, n_name, code, CASE c_custkey % 5 WHEN 0 THEN n_name WHEN 1 THEN '0000' WHEN 2 THEN NULL WHEN 3 THEN 'Campus avancado de' ELSE n_name || ' - x' END AS first, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(n_name) ELSE '1111' END AS second, c_custkey % 2 = 1 AS told, c_custkey % 7 = 0 AS placed FROM customer JOIN n ON code = c_nationkey::VARCHAR)"""


@query(f"""WITH {_UNITS}, m AS (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN 'exact_match' WHEN c_custkey % 5 = 4 OR (c_custkey % 5 = 3 AND told) THEN 'rule_match' WHEN c_custkey % 3 = 1 THEN 'exact_match' WHEN placed THEN 'rule_match' WHEN c_custkey % 5 = 3 THEN 'needs_review' ELSE 'unknown' END AS status,
CASE WHEN c_custkey % 5 IN (0, 4) THEN 1 WHEN c_custkey % 5 = 3 AND told THEN 2 WHEN c_custkey % 3 = 1 THEN 3 WHEN placed THEN 4 END AS how FROM c)
SELECT c_custkey, status, CASE how WHEN 1 THEN coalesce((SELECT min_by(n.code, n.code::INT) FROM n WHERE c_custkey % 5 = 4 AND contains(trim(regexp_replace(lower(first), '[^a-z0-9]+', ' ', 'g')), n.k)), code) WHEN 2 THEN '17' WHEN 3 THEN code WHEN 4 THEN '3' END AS code FROM m""")
def c4_article_units(spark, sf_dir):
    """Labels in their order, one that only the title settles, the source's unit, and what is left for review."""
    nation = read(spark, sf_dir, "nation")
    alias = nation.select(text.comparison_key(F.col("n_name")).alias("alias_key"), F.col("n_nationkey").cast("string").alias("code"))
    fragments = alias.select(F.col("alias_key").alias("fragment"), "code", F.col("code").cast("int").alias("ord"))
    who, key = F.col("n_name"), F.col("c_custkey")
    first = F.when(key % 5 == 0, who).when(key % 5 == 1, "0000").when(key % 5 == 3, "Campus avancado de").when(key % 5 == 4, F.concat(who, F.lit(" - x")))
    second = F.when(key % 3 == 0, "").when(key % 3 == 1, F.lower(who)).otherwise("1111")
    people = read(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = people.select("c_custkey", first.alias("first"), second.alias("second"), F.when(key % 2 == 1, "A day in Perú").alias("title"), F.when(key % 7 == 0, "3").alias("home"))
    found = units.article_units(rows, "c_custkey", ["first", "second"], ["title"], alias, fragments, "campus avancado de", [(r"\bperu\b", "17"), ("japan", "12")], "home")
    return found.select("c_custkey", "status", "code")


@query("""WITH o AS (SELECT user_id AS case_id, (['a','b','c','d'])[event_id % 4 + 1] AS configuration, event_id % 90 <> 0 AS ok, event_id % 110 = 0 AS bad, event_id % 40 <> 1 AS scored FROM events), g AS (SELECT case_id, count(*) AS n, count(DISTINCT configuration) AS k, count_if(NOT ok) AS failed, count_if(bad) AS bad, count_if(scored) AS s, count(DISTINCT configuration) FILTER (scored) AS sk FROM o GROUP BY 1)
SELECT case_id, unnest(list_filter([CASE WHEN n <> 4 OR k <> 4 THEN 'outputs' END, CASE WHEN failed > 0 THEN 'not ok' END, CASE WHEN bad > 0 THEN 'parse error' END, CASE WHEN s <> 4 OR sk <> 4 THEN 'scores' END], lambda x: x IS NOT NULL)) AS problem FROM g""")
def f17_incomplete_cases(spark, sf_dir):
    e = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.get(F.lit(["a", "b", "c", "d"]), (e % 4).cast("int")).alias("configuration"), F.when(e % 90 != 0, "ok").otherwise("failed").alias("status"), F.when(e % 110 == 0, "bad").otherwise("").alias("parse_error"), (e % 40 != 1).alias("scored"))
    return cases.incomplete(rows, rows.where("scored"), ["a", "b", "c", "d"])
