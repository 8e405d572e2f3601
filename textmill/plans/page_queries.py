"""Pages: addresses, titles, links, articles, discovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import crawl, html
from .registry import query, read

PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
QUERY = r"regexp_extract(url, '\?([^#]*)', 1)"
TIDY = f"regexp_replace(CASE WHEN {PATH} = '' THEN '/' ELSE {PATH} END, '/{{2,}}', '/', 'g')"
KEPT = f"list_filter(string_split({QUERY}, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT list_contains(['fbclid','gclid','mc_cid','mc_eid','ref','source'], lower(split_part(x, '=', 1))))"
NORMALIZED = f"regexp_extract(url, '^([a-z]+://)', 1) || lower({HOST}) || {TIDY} || CASE WHEN len({KEPT}) = 0 THEN '' ELSE '?' || array_to_string(list_transform({KEPT}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') END"


@query(f"SELECT page_id, {NORMALIZED} AS normalized FROM pages")
def u1_normalize_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("normalized"))


@query(rf"SELECT page_id, regexp_matches({PATH}, '\.(pdf|html?|jpg|png|zip)$') AND NOT regexp_matches({PATH}, '\.html?$') AS static, list_last(string_split(trim({PATH}, '/'), '/')) AS slug, lower({HOST}) AS host, lower(regexp_extract({PATH}, '(\.[^./]+)$', 1)) AS extension, ends_with(lower({HOST}), '.example.org') OR lower({HOST}) = 'example.org' AS in_org FROM pages")
def u3_url_parts(spark, sf_dir):
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", urls.static_extension(u).alias("static"), urls.slug(u).alias("slug"), urls.host(u).alias("host"), urls.extension(u).alias("extension"), urls.host_is(u, "example.org").alias("in_org"))


@query(rf"SELECT regexp_replace(regexp_replace({PATH}, '/\d+(/|$)', '/{{id}}\1'), '/\d+(\.[a-z]+)$', '/{{id}}\1') AS template, count(*) AS n, count(DISTINCT {HOST}) AS hosts FROM pages GROUP BY 1")
def u12_path_template(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(urls.path_template(F.col("url")).alias("template"), urls.host(F.col("url")).alias("host"))
    return rows.groupBy("template").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts"))


@query(r"SELECT CASE WHEN regexp_matches(url, '[?&]page=\d+') THEN 'query_page' WHEN regexp_matches(url, '[?&]pagina=\d+') THEN 'query_pagina' WHEN regexp_matches(url, '/page/\d+') THEN 'path_page' WHEN regexp_matches(url, '/pagina/\d+') THEN 'path_pagina' END AS pattern, count(*) AS n, min_by(url, page_id) AS example FROM pages GROUP BY 1")
def u15_pagination(spark, sf_dir):
    return read(spark, sf_dir, "pages").groupBy(urls.pagination_pattern(F.col("url")).alias("pattern")).agg(F.count("*").alias("n"), F.min_by("url", "page_id").alias("example"))


@query(f"WITH n AS (SELECT page_id, url, {NORMALIZED} AS normalized FROM pages) SELECT normalized, min(page_id) AS first_id, min_by(url, page_id) AS first_url, (count(DISTINCT url) - 1)::INT AS alternatives FROM n GROUP BY 1")
def o4_distinct_url(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url", urls.normalize_url(F.col("url")).alias("normalized"))
    return crawl.distinct_urls(rows, "url", "page_id").withColumn("alternatives", F.size("alternatives"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, coalesce(list_max(list_transform(regexp_extract_all(html, '[?&]page=(\d+)', 1), lambda x: x::INT)), 1)::INT AS last_page, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS fingerprint FROM pages")
def h1_title_last_page(spark, sf_dir):
    h = F.col("html")
    numbers = F.transform(F.regexp_extract_all(h, F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", text.collapse(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.coalesce(F.array_max(numbers), F.lit(1)).alias("last_page"), text.fingerprint(h).alias("fingerprint"))


@query("""SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY ALL""")
def h20_raw_links(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a\\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT page_id, src FROM (SELECT page_id, unnest(regexp_extract_all(html, '<img\\s[^>]*src="([^"]*)"', 1)) AS src FROM pages)""")
def h19_raw_images(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<img\\s[^>]*src="([^"]*)"'), F.lit(1))).alias("src"))


@query()
def h8_article_parse(spark, sf_dir):
    return html.articles(read(spark, sf_dir, "pages")).drop("links", "images", "og_image").withColumn("tags", F.array_join("tags", ","))


@query()
def h20_links(spark, sf_dir):
    return html.links_of(html.articles(read(spark, sf_dir, "pages")), "example.org")


@query()
def h19_media(spark, sf_dir):
    return html.media_of(html.articles(read(spark, sf_dir, "pages")))


@query()
def h28_link_summary(spark, sf_dir):
    return html.links_of(html.articles(read(spark, sf_dir, "pages")), "example.org").groupBy("link_type").agg(F.count("*").alias("n"), F.count_distinct("normalized").alias("different"))


WALK = f"(SELECT page_id % 10 AS source, page_id // 10 AS page, CASE WHEN page_id % 83 = 82 THEN 404 ELSE 200 END AS status, length(html) AS size, left(md5(html), 2) AS fp, len(regexp_extract_all(html, '<a ')) AS links FROM pages)"


@query(f"WITH w AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY page) > 1 AS seen FROM {WALK}), r AS (SELECT *, CASE WHEN status <> 200 THEN 'not_found' WHEN size < 200 THEN 'small_page' WHEN seen THEN 'repeated_page' WHEN links = 0 THEN 'no_links' END AS reason FROM w) SELECT source, min(page) FILTER (reason IS NOT NULL) AS stop_page, min_by(reason, page) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY 1")
def w21_stop_page(spark, sf_dir):
    walk = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("source"), F.floor(F.col("page_id") / 10).alias("page"), F.when(F.col("page_id") % 83 == 82, 404).otherwise(200).alias("status"), F.length("html").alias("size"), F.left(F.md5("html"), F.lit(2)).alias("fp"), F.regexp_count("html", F.lit("<a ")).alias("links"))
    return crawl.stop_page(walk, "source", "page", "status", "size", "fp", "links")


@query(f"SELECT host, page_id, url FROM (SELECT {HOST} AS host, page_id, url, length(html) AS n FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY n DESC, page_id) = 1")
def w8_best_per_host(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), "page_id", "url", F.length("html").alias("n"))
    return crawl.best_attempt(rows, "host", F.col("n"), "page_id").drop("n")


@query("SELECT n_name AS source, page, CASE WHEN page = 1 THEN 'https://' || lower(n_name) || '/' WHEN n_nationkey % 2 = 0 THEN 'https://' || lower(n_name) || '/page/' || page || '/' ELSE 'https://' || lower(n_name) || '/?page=' || page END AS listing_url FROM nation, (SELECT unnest(range(1, 6))::INT AS page)")
def src14_listing_urls(spark, sf_dir):
    sources = read(spark, sf_dir, "nation").select(F.col("n_name").alias("source"), "n_nationkey", F.concat(F.lit("https://"), F.lower("n_name"), F.lit("/")).alias("base"))
    return crawl.listing_urls(sources, "base", 5, F.col("n_nationkey") % 2 == 0).select("source", "page", "listing_url")
