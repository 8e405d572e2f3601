"""Old portals: lines and articles of pages, blocks of content, links by family, diagnosis of hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import urls
from ..operators import diagnosis, listings, old_portal
from ..operators.old_portal import Portal
from ..sources import attempts
from .page_queries import NORMALIZED
from .registry import query, read
from .text_queries import NORMAL

PORTAL = Portal("example")
_PLAIN = r"regexp_replace(replace(replace(replace({}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g')".replace('\\"', '"')
_SHOWN = r"regexp_replace({}, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', '<br>', 'g')"
_LINES = r"list_filter(list_transform(regexp_split_to_array({}, '<[^>]*>|\n'), lambda x: trim(regexp_replace({}, '\s+', ' ', 'g'))), lambda x: x <> '')"
LINES = _LINES.format(_SHOWN.format("html"), _PLAIN.format("x"))
SPOKEN = r"trim(regexp_replace(lower({}), '[^a-z0-9À-ÿ]+', ' ', 'g'))"
_X, _T = SPOKEN.format("x"), SPOKEN.format("title")
_WORDS = r"len(regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+'))::INT"
_DATES = [r"(?:^|[^\p{L}\p{N}_])(\d{1,2}/\d{1,2}/\d{2,4})(?:$|[^\p{L}\p{N}_])", r"(?i)(?:^|[^\p{L}\p{N}_])(\d{1,2}\s+de\s+[A-Za-zÀ-ÿ]+(?:\s+de\s+\d{4})?)(?:$|[^\p{L}\p{N}_])", r"(?i)(?:^|[^\p{L}\p{N}_])(\d{1,2}\s+[A-Za-zÀ-ÿ]{3,})(?:$|[^\p{L}\p{N}_])"]
_AUTHOR = rf"(NOT starts_with({_X}, 'site desativado') AND (regexp_matches(' ' || {_X} || ' ', ' (ascom|assessoria|comunicacao|comunicação) ') OR (regexp_matches(' ' || {_X} || ' ', ' example ') AND contains(x, '/') AND length(x) <= 120 AND len(string_split(x, ' ')) <= 8)))"
_END = rf"({_X} IN ('cursos', 'a rede', 'documentos') OR regexp_matches(lower(x), '\.(pdf|docx?|xlsx?)$|^(edital |instrucao normativa|instrução normativa)'))"
#: Tables ``l`` (key, lines, title) and on: what ``old_portal.line_scan`` says.
SCAN = f"""p AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: {_X}), {_T}), 0) AS exact, coalesce(list_position(list_transform(lines, lambda x: contains({_X}, {_T})), true), 0) AS held FROM l),
a AS (SELECT *, CASE WHEN {_T} = '' OR greatest(exact, held) = 0 THEN [] ELSE lines[(CASE WHEN exact > 0 THEN exact ELSE held END) + 1:] END AS rest FROM p),
e AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: {_END}), true), 0) AS e FROM a), k AS (SELECT *, CASE WHEN e > 0 THEN rest[:e - 1] ELSE rest END AS kept FROM e),
w AS (SELECT *, coalesce(list_position(list_transform(kept, lambda x: {_AUTHOR}), true), 0) AS w FROM k),
b AS (SELECT *, CASE WHEN w > 0 THEN kept[w] ELSE '' END AS author, array_to_string(list_filter(kept, lambda x, i: i <> w), chr(10) || chr(10)) AS text FROM w),
d AS (SELECT *, CASE WHEN text = '' THEN array_to_string(lines, chr(10)) ELSE text END AS dated FROM b),
scanned AS (SELECT *, coalesce({', '.join(f"nullif(trim(regexp_replace(regexp_extract(dated, '{x}', 1), '[ ]+', ' ', 'g')), '')" for x in _DATES)}, '') AS date_label, CASE WHEN contains({SPOKEN.format('author')}, 'reitoria') THEN 'Reitoria' WHEN regexp_matches(author, '(?i)campus\\s+[A-Za-zÀ-ÿ0-9 -]+') THEN trim('Campus ' || regexp_extract(author, '(?i)campus\\s+([A-Za-zÀ-ÿ0-9 -]+)', 1)) ELSE '' END AS publisher, {_WORDS.format('text')} AS words, left({NORMAL}, 500) AS preview FROM d)"""


@query(f"SELECT page_id, len({LINES})::INT AS n, sha256(array_to_string({LINES}, chr(10))) AS digest FROM pages")
def h23_lines(spark, sf_dir):
    """The lines of text of each page, in order."""
    rows = read(spark, sf_dir, "pages").select("page_id", old_portal.lines("html").alias("l"))
    return rows.select("page_id", F.size("l").alias("n"), F.sha2(F.array_join("l", "\n"), 256).alias("digest"))


@query(f"WITH l AS (SELECT page_id, {LINES} AS lines, coalesce({LINES}[8], '') AS title FROM pages), {SCAN} SELECT page_id, title, date_label, author, publisher, words, preview FROM scanned")
def h25_line_scan(spark, sf_dir):
    """Fields of each page that follow the text of its last menu entry."""
    rows = read(spark, sf_dir, "pages").select("page_id", old_portal.lines("html").alias("lines")).withColumn("title", F.coalesce(F.try_element_at("lines", F.lit(8)), F.lit("")))
    return rows.withColumn("s", old_portal.line_scan(F.col("lines"), F.col("title"), PORTAL)).select("page_id", "title", "s.*")


@query()
def h21_portal_articles(spark, sf_dir):
    """Each page as an article of an old portal, without a listed title."""
    return old_portal.articles(read(spark, sf_dir, "pages").withColumn("listed_title", F.lit("")), PORTAL)


_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_SAID = f"array_to_string({_LINES.format(_SHOWN.format(_ARTICLE), _PLAIN.format('x'))}, ' ')"


@query(rf"SELECT page_id, 'article' AS selector, length({_SAID})::INT AS chars, {_WORDS.format(_SAID)} AS words, len(regexp_extract_all({_ARTICLE}, '<p[ >]'))::INT AS paragraphs, len(regexp_extract_all({_ARTICLE}, '<a '))::INT AS links, left({_SAID}, 240) AS preview FROM pages")
def h27_content_blocks(spark, sf_dir):
    """Blocks of each page that may hold its content."""
    return read(spark, sf_dir, "pages").select("page_id", F.inline(old_portal.content_blocks("html"))).drop("tag", "id", "classes")


KINDS = ["^/[A-Z]", "^/[^/]{2,4}$"]
#: The links of pages as DuckDB reads them, and the first of their two families that takes each.
LINKS = rf"""h AS (SELECT key, base, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS position FROM (SELECT key, base, list_transform(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1), lambda x: {_PLAIN.format('x')}) AS hrefs FROM source)),
u AS (SELECT key, position, regexp_extract(base, '^[a-z]+://[^/?#]*') || regexp_replace(trim(href), '#.*$', '') AS url FROM h WHERE starts_with(trim(href), '/')),
f AS (SELECT *, {NORMALIZED} AS normalized, CASE WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '{KINDS[0]}') THEN 0 WHEN regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '{KINDS[1]}') THEN 1 END AS family FROM u),
g AS (SELECT key, normalized, min(family * 1000000 + position) AS spot, min_by(url, family * 1000000 + position) AS address FROM f WHERE family IS NOT NULL GROUP BY ALL),
united AS (SELECT *, spot // 1000000 AS family, row_number() OVER (PARTITION BY key ORDER BY spot) AS place FROM g)"""


def kinds():
    """Two families by the path: capitals first, then short ones."""
    path = urls.path(F.col("address"))
    return [F.when(path.rlike(p), name) for p, name in zip(KINDS, ("capital", "short"))]


@query(f"WITH source AS (SELECT page_id AS key, url AS base, html FROM pages), {LINKS} SELECT key AS page_id, place, normalized, family::INT AS family, CASE family WHEN 0 THEN 'capital' ELSE 'short' END AS kind FROM united")
def h26_link_union(spark, sf_dir):
    """Each address of a page in the first of two families that takes it."""
    found = diagnosis.link_union(listings.anchor_rows(read(spark, sf_dir, "pages")), kinds(), [])
    return found.select("page_id", F.col("place").cast("long").alias("place"), "normalized", "family", "kind")


def _fetched(spark, sf_dir):
    """The pages as ten hosts' listings, one page number each; every seventh of them did not open."""
    page, host = F.floor(F.col("page_id") / 10) + 1, F.concat(F.lit("http://s"), (F.col("page_id") % 10).cast("string"), F.lit(".example.org/noticias/"))
    url = F.when(page == 1, host).otherwise(F.concat(host, F.lit("?page="), page.cast("string")))
    return read(spark, sf_dir, "pages").select(url.alias("url"), F.lit(None).cast("string").alias("final_url"), F.when(F.col("page_id") % 7 == 6, 500).otherwise(200).alias("status"), "html")


@query(rf"""WITH fetched AS (SELECT page_id % 10 AS s, page_id // 10 + 1 AS page, 'http://s' || page_id % 10 || '.example.org/noticias/' AS base, page_id % 7 <> 6 AS opened, html, sha256(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS print FROM pages WHERE page_id // 10 + 1 IN (1, 2, 10, 50)),
source AS (SELECT s * 100 + page AS key, base, html FROM fetched), {LINKS}, n AS (SELECT key, count(*) AS n, list_sort(list(normalized) FILTER (place <= 10)) AS first FROM united GROUP BY 1),
r AS (SELECT s, page, opened, print, coalesce(n.n, 0) AS n, coalesce(n.first, []) AS first FROM fetched LEFT JOIN n ON key = s * 100 + page), b AS (SELECT * FROM r WHERE page = 1),
t AS (SELECT b.s, bool_or(r.opened AND r.n > 0 AND r.print <> b.print AND r.first <> b.first) AS works, bool_or(r.n > 0) AS later FROM b JOIN r USING (s) WHERE r.page > 1 AND b.opened GROUP BY 1)
SELECT 's' || b.s || '.example.org' AS host, 'http://s' || b.s || '.example.org/noticias/' AS best_url, b.opened, b.n::BIGINT AS candidates, b.n > 0 OR coalesce(t.later, false) AS has_news, coalesce(t.works, false) AS paging_works FROM b LEFT JOIN t USING (s)""")
def c8_host_report(spark, sf_dir):
    """Each host's best listing, its links, and whether it pages."""
    fetched = _fetched(spark, sf_dir)
    tested = fetched.where("not contains(url, '?')").select("url")
    return diagnosis.diagnose(tested, fetched, kinds(), [], PORTAL).hosts.select("host", "best_url", "opened", "candidates", "has_news", "paging_works")


def _scripted(url: str, verify: bool, timeout: float) -> tuple[int, str, str]:
    """Answers by the length of the address from its host on."""
    import ssl

    kind = len(url.split("://", 1)[1]) % 6
    if kind == 0 and verify:
        raise ssl.SSLError("certificate")
    if kind == 1:
        raise TimeoutError("late")
    if kind == 3 and url.startswith("https:"):
        return 403, url, ""
    return (503, url, "") if kind == 2 else (200, url, f"<p>{len(url)}</p>")


_KIND = "length(regexp_extract(url, '://(.*)$', 1)) % 6"
_AFTER = f"""t AS (SELECT page_id, url, {_KIND} AS k, starts_with(url, 'https:') AS secure FROM pages),
a AS (SELECT page_id, k, url, unnest(CASE WHEN k IN (0, 1) AND secure THEN ['first', 'first', 'first', 'plain'] || CASE k WHEN 1 THEN ['plain', 'plain'] ELSE [] END WHEN k IN (0, 1) THEN ['first', 'first', 'first'] WHEN k = 2 AND secure THEN ['first', 'first', 'first', 'plain', 'plain', 'plain'] WHEN k = 2 THEN ['first', 'first', 'first'] WHEN k = 3 AND secure THEN ['first', 'plain'] ELSE ['first'] END) AS rung,
  generate_subscripts(CASE WHEN k IN (0, 1) AND secure THEN [0, 1, 2, 0] || CASE k WHEN 1 THEN [1, 2] ELSE [] END WHEN k IN (0, 1) THEN [0, 1, 2] WHEN k = 2 AND secure THEN [0, 1, 2, 0, 1, 2] WHEN k = 2 THEN [0, 1, 2] WHEN k = 3 AND secure THEN [0, 0] ELSE [0] END, 1) - 1 AS n FROM t)"""


@query(f"WITH {_AFTER} SELECT page_id, n::INT AS n, rung, CASE WHEN rung = 'plain' THEN 'http' || substr(url, 6) ELSE url END AS request_url, rung = 'first' AS verify, (CASE WHEN k = 1 OR k = 0 AND rung = 'first' THEN NULL WHEN k = 2 THEN 503 WHEN k = 3 AND rung = 'first' AND starts_with(url, 'https:') THEN 403 ELSE 200 END)::INT AS status, CASE WHEN k = 1 THEN 'TimeoutError' WHEN k = 0 AND rung = 'first' THEN 'SSLError' ELSE '' END AS error_type FROM a")
def src9_attempts(spark, sf_dir):
    """Every attempt on the addresses of the pages, from a scripted fetcher; all hosts allow plain HTTP."""
    ladder = attempts.Ladder(delay=0, backoff=0, plain_hosts=("com", "org", "net"))
    found = attempts.attempts(read(spark, sf_dir, "pages").select("page_id", "url"), _scripted, ladder)
    return found.select("page_id", "n", "rung", "request_url", "verify", "status", "error_type")


@query(f"SELECT page_id, (CASE {_KIND} WHEN 1 THEN NULL WHEN 2 THEN 503 WHEN 3 THEN CASE WHEN starts_with(url, 'https:') THEN 403 ELSE 200 END ELSE 200 END)::INT AS status, {_KIND} <> 0 AS verify, {_KIND} = 0 AS verify_false_needed, {_KIND} = 0 AS had_tls_error, CASE WHEN {_KIND} = 0 THEN 2 ELSE 1 END::BIGINT AS attempts FROM pages")
def src10_selected(spark, sf_dir):
    """What a diagnosis takes: one attempt, and one without verification after a TLS error."""
    ladder = attempts.Ladder(retries=0, delay=0, unverified_on_tls=True)
    found = attempts.selected(attempts.attempts(read(spark, sf_dir, "pages").select("page_id", "url"), _scripted, ladder))
    return found.select("page_id", "status", "verify", "verify_false_needed", (F.col("tls_error") != "").alias("had_tls_error"), "attempts")
