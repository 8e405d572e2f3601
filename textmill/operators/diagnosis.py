"""Diagnosis of sources from pages that were fetched: what their listings link to, whether they page, whether articles can be read.

``fetched`` is a table of pages: url (as asked for), final_url, status, html; of several rows of one address the one with
the longest text counts, then the smallest final address. Everything is keyed by address or host, so a host's part is as
large as what was fetched of it, and the report has one row a host.

An address that was asked for and is not in the table did not open. Null and empty pages did not open either; they have no
links. Equal ranks are decided by the smaller address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import links, text, urls
from ..sources.scratch import stage
from . import listings, old_portal

# Fixed values.
PAGES_TESTED = [2, 10, 50]
STYLES = {"query_page": ("?page=", ""), "path_page": ("page/", "/"), "query_pagina": ("?pagina=", "")}
FIRST_LINKS, ARTICLES_TESTED = 10, 3

#: Of several rows of one address, the one to take.
LONGEST = "struct(-length(coalesce(html, '')), coalesce(final_url, ''), status, html)"


def families(own_domain: str, legacy_host: str, portal: str) -> list[Column]:
    """The kinds of an anchor by family: news links of any site, then addresses of the old portal."""
    at = F.col("address")
    old = F.when(urls.host_is(at, portal) & ~urls.static_extension(at), F.nullif(links.old_portal_kind(at), F.lit("")))
    return [links.news_kind(at, F.col("label"), F.col("navigation"), F.col("inside"), own_domain, legacy_host), old]


def link_union(anchors: DataFrame, kinds: list[Column], publishers: list[str], key: str = "page_id") -> DataFrame:
    """One row for each normalised address of a page: the first family that takes it, described by its fullest anchor.

    Places go by family, then by the first anchor of the family. Families after the first take the label as the title.
    """
    return _united(_taken(anchors, kinds, publishers, key), key)


def _taken(anchors: DataFrame, kinds: list[Column], publishers: list[str], key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The anchors that a family takes, with the few columns that describe them; also those with a value in ``more``."""
    family = F.coalesce(*(F.when(k.isNotNull(), i) for i, k in enumerate(kinds)))
    rows = anchors.withColumns({"family": family, "kind": F.coalesce(*kinds)}).where(F.coalesce(F.col("family").cast("string"), *more).isNotNull())
    rows = listings.described(rows, publishers).withColumn("title", F.when(F.col("family") == 0, F.col("title")).otherwise(F.col("label")))
    return rows.select(key, *more, "position", "family", "quality", urls.normalize_url(F.col("address")).alias("normalized"), F.struct("address", "href", "kind", *listings.FIELDS).alias("said"))


def _united(taken: DataFrame, key: str) -> DataFrame:
    best = F.min_by("said", F.struct("family", -F.col("quality"), "position"))
    found = taken.groupBy(key, "normalized").agg(F.min(F.struct("family", "position")).alias("at"), best.alias("said"))
    # the links of one page are placed within an array
    placed = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "normalized", "said"))).alias("all")).select(key, F.posexplode("all").alias("i", "x"))
    return placed.select(key, (F.col("i") + 1).alias("place"), "x.normalized", "x.at.family", "x.said.*").withColumn("relative_href", urls.relative(F.col("href")))


def individual_path(url: Column) -> Column:
    """How an article's address is built: its last part by what it is."""
    path = links.closed_path(url)
    folder = F.regexp_extract(path, "^(.*/)[^/]+/$", 1)
    return F.when(path.rlike(r"^/noticias/\d+/$"), "/noticias/{id}/").when(F.lower(path).rlike("^/noticias/[a-z0-9-]+/$"), "/noticias/{slug}/").when(folder == "", path).otherwise(F.concat(folder, F.lit("{article}/")))


def _counted(rows: DataFrame, key: str, by: Column, name: str, what: str) -> DataFrame:
    """A map of counts for each page, in order."""
    n = rows.withColumn("_by", by).where("_by is not null").groupBy(key, "_by").agg(F.count_distinct(what).alias("_n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_by", "_n")))).alias(name))


def listing_report(fetched: DataFrame, kinds: list[Column], publishers: list[str]) -> DataFrame:
    """One row for each address: whether it opened, its title and size, its news links by kind and path, its paging links.

    Pages are read where they are: what is shuffled is a short row of each, and its links. ``row`` tells several pages of
    one address apart.
    """
    body = text.filled(F.col("html"))
    final = F.coalesce(F.nullif("final_url", F.lit("")), "url")
    row = F.md5(F.concat_ws("\n", "url", final, F.coalesce(F.col("status").cast("string"), F.lit("")), F.md5(body)).cast("binary"))
    pages = fetched.withColumns({"row": row, "final": final})
    opened = F.coalesce(F.col("status").between(200, 399), F.lit(False)) & (body != "")
    short = pages.select("url", "row", "final", "status", opened.alias("opened"), F.length(body).alias("size"), text.collapse(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.when(body != "", text.fingerprint(body)).otherwise("").alias("fingerprint"))
    one = F.min_by(F.struct("row", "final", "status", "opened", "size", "title", "fingerprint"), F.struct(-F.col("size"), "final", "status", "row"))
    short = short.groupBy("url").agg(one.alias("p")).select("url", "p.*")
    anchors = listings.anchor_rows(pages, "row", "final", "html").withColumn("style", urls.pagination_pattern(F.col("address")))
    # a page's tree is built once
    taken = stage(_taken(anchors, kinds, publishers, "row", ("style",)), "anchors")
    union = stage(_united(taken.where("family is not null"), "row").select("row", "place", "normalized", "address", "title", "kind"), "union")
    first = F.array_sort(F.collect_list(F.when(F.col("place") <= FIRST_LINKS, F.struct("place", "address", "title", "normalized"))))
    totals = union.groupBy("row").agg(F.count("*").alias("candidates"), first.alias("first_links"))
    found = short
    for part in (totals, _counted(union, "row", F.col("kind"), "kinds", "place"), _counted(union, "row", individual_path(F.col("address")), "paths", "place"), _counted(taken, "row", F.col("style"), "paging_links", "position")):
        found = found.join(part, "row", "left")
    return found.select(
        "url", urls.host(F.col("url")).alias("host"), "status", "opened", (F.col("final") != F.col("url")).alias("redirected"), F.col("final").alias("final_url"), "size", "title", F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.coalesce("first_links", F.array().cast(totals.schema["first_links"].dataType)).alias("first_links"), *(F.coalesce(m, F.create_map().cast("map<string,bigint>")).alias(m) for m in ("kinds", "paths", "paging_links")), "fingerprint",
    )


def signature(first_links: Column) -> Column:
    """The addresses of the first links in any order."""
    return F.array_sort(F.transform(first_links, lambda x: x["normalized"]))


def base_of(url: Column) -> Column:
    """Scheme, host and path, with a slash at the end."""
    base = F.concat(urls.part(url, 1), F.lit("://"), urls.part(url, 2), urls.path(url))
    return F.when(F.endswith(base, F.lit("/")), base).otherwise(F.concat(base, F.lit("/")))


def best_listings(tested: DataFrame, report: DataFrame) -> DataFrame:
    """The listing of each host that opened, has most links, is secure, and is short."""
    rows = tested.select("url").distinct().join(report.drop("host"), "url", "left").withColumns({"host": urls.host(F.col("url")), "opened": F.coalesce("opened", F.lit(False)), "candidates": F.coalesce("candidates", F.lit(0)), "size": F.coalesce("size", F.lit(0))})
    rank = F.struct(~F.col("opened"), -F.col("candidates"), ~F.startswith("url", F.lit("https://")), "size", "url")
    return rows.groupBy("host").agg(F.min_by(F.struct("url", "final_url", "opened", "candidates", "size", "title", "first_links", "fingerprint", "kinds", "paths", "paging_links"), rank).alias("b"), F.count("*").alias("tested")).select("host", "tested", "b.*")


def paging_addresses(best: DataFrame) -> DataFrame:
    """The addresses that show whether a listing pages: three styles, three pages each."""
    base = base_of(F.coalesce("final_url", "url"))
    styles = F.explode(F.array(*(F.struct(F.lit(n).alias("style"), F.lit(a).alias("before"), F.lit(z).alias("after")) for n, (a, z) in STYLES.items())))
    rows = best.where("opened").select("host", base.alias("base"), F.col("fingerprint").alias("first_print"), signature(F.col("first_links")).alias("first_signature"), styles.alias("s"))
    rows = rows.withColumn("page", F.explode(F.array(*map(F.lit, PAGES_TESTED))))
    return rows.select("host", "s.style", "page", F.concat("base", "s.before", F.col("page").cast("string"), "s.after").alias("url"), "first_print", "first_signature")


def paging_tests(best: DataFrame, report: DataFrame) -> DataFrame:
    """Each test of a host: a page works if it opened, has links, and is neither the first page nor links to the same."""
    held = report.select("url", "opened", F.col("candidates").alias("n"), "first_links", "fingerprint")
    rows = paging_addresses(best).join(held, "url", "left")
    same = F.coalesce((F.col("fingerprint") == F.col("first_print")) & (F.col("fingerprint") != ""), F.lit(False))
    works = F.coalesce(F.col("opened") & (F.col("n") > 0) & ~same & (signature(F.col("first_links")) != F.col("first_signature")), F.lit(False))
    return rows.select("host", "style", "page", "url", F.coalesce("opened", F.lit(False)).alias("opened"), F.coalesce("n", F.lit(0)).alias("candidates"), same.alias("same_as_first"), works.alias("works"), "first_links")


def article_tests(best: DataFrame, tests: DataFrame, fetched: DataFrame, portal: old_portal.Portal, most: int = ARTICLES_TESTED) -> DataFrame:
    """The first articles of each host as an old portal's line scan reads them.

    They are those that the listing links to; where it links to none, those of the first test that links to any, one that
    works before others.
    """
    later = tests.where("candidates > 0").groupBy("host").agg(F.min_by("first_links", F.struct(~F.col("works"), "page", "style")).alias("later"))
    chosen = best.where("opened").join(later, "host", "left").select("host", F.explode(F.slice(F.when(F.col("candidates") > 0, F.col("first_links")).otherwise(F.col("later")), 1, most)).alias("c")).select("host", "c.place", F.col("c.address").alias("url"), F.col("c.title").alias("listed_title"))
    longest = F.min_by(F.struct("status", "html"), F.expr(LONGEST))
    pages = fetched.join(chosen.select("url").distinct(), "url", "left_semi").groupBy("url").agg(longest.alias("p")).select("url", "p.*")
    rows = chosen.join(pages, "url", "left").withColumn("opened", F.coalesce(F.col("status").between(200, 399) & (F.col("html") != ""), F.lit(False)))
    rows = rows.withColumn("lines", old_portal.lines(F.when(F.col("opened"), F.col("html"))))
    scanned = rows.withColumn("s", old_portal.line_scan(F.col("lines"), F.col("listed_title"), portal))
    return scanned.select("host", "place", "url", "listed_title", "opened", "s.*").withColumn("extractable", F.col("opened") & (text.filled(F.col("listed_title")) != "") & (F.col("words") > 0))


@dataclass
class Diagnosis:
    """The tables of a run: one row a listing, a paging test, an article test, a host."""

    listings: DataFrame
    paging: DataFrame
    articles: DataFrame
    hosts: DataFrame

    def summary(self) -> DataFrame:
        """How many hosts opened, have news, page, and are recommended."""
        names = ("opened", "has_news", "paging_works", "recommended")
        return self.hosts.agg(F.count("*").alias("hosts"), *(F.count_if(n).alias(n) for n in names))


def diagnose(tested: DataFrame, fetched: DataFrame, kinds: list[Column], publishers: list[str], portal: old_portal.Portal, most: int = ARTICLES_TESTED) -> Diagnosis:
    """Tests the listings at the addresses of ``tested`` (url) against what was fetched.

    A host is recommended if its best listing opened, news were found on it or on a later page, and one article could be
    read.
    """
    report = stage(listing_report(fetched, kinds, publishers), "listings")
    best = stage(best_listings(tested, report), "best")
    paging = stage(paging_tests(best, report), "paging")
    read = stage(article_tests(best, paging, fetched, portal, most), "read")
    paged = paging.groupBy("host").agg(F.bool_or("works").alias("paging_works"), F.bool_or(F.col("candidates") > 0).alias("later_news"))
    tests = read.groupBy("host").agg(F.count("*").alias("articles_tested"), F.count_if("extractable").alias("extractable"))
    hosts = best.join(paged, "host", "left").join(tests, "host", "left").na.fill({"paging_works": False, "later_news": False, "articles_tested": 0, "extractable": 0})
    hosts = hosts.withColumn("has_news", (F.col("candidates") > 0) | F.col("later_news"))
    hosts = hosts.select("host", "tested", F.col("url").alias("best_url"), "opened", "candidates", "has_news", "paging_works", "articles_tested", "extractable", (F.col("opened") & F.col("has_news") & (F.col("extractable") > 0)).alias("recommended"))
    return Diagnosis(report, paging.drop("first_links"), read, hosts)
