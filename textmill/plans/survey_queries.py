"""Links, questions, lookups, pairs without blocks, canonical choice, reports and previews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, questions, text, urls, values
from ..operators import articles, cases, crawl, dedupe, reports
from ..sources.scratch import stage
from .corpus_queries import ARTICLES, arts
from .dedupe_queries import EDGES, GROUPED, KEYED, REACH, grouped, keyed
from .evaluation_queries import CASE, SCORED, masked_cases, scored
from .page_queries import NORMALIZED
from .registry import query, read
from .text_queries import CONTENT, KEY, NORMAL, TOKENS


def of(sql: str, expression: str) -> str:
    """The SQL of a text function for another expression than the column text."""
    return sql.replace("coalesce(text", f"coalesce({expression}")


# Fixed values.
FOLDED = ("áàâãäéêèíìóôõöúüç", "aaaaaeeeiioooouuc")
FOLD_FROM, FOLD_TO = FOLDED[0] + FOLDED[0].upper(), FOLDED[1] + FOLDED[1].upper()


@query(f"SELECT doc_id, translate(text, '{FOLD_FROM}', '{FOLD_TO}') AS folded FROM documents")
def t4_fold_letters(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.fold_letters(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, coalesce(unit, '') || ' ' || coalesce(title, '') || ' ' || coalesce(published, '') || ' ' || coalesce(environment, '') AS context FROM {ARTICLES}")
def t26_context_text(spark, sf_dir):
    return arts(spark, sf_dir).select("doc_id", text.context_text("unit", "title", "published", "environment").alias("context"))


HOSTS = ["example.org", "old.example.org", "example.net", "10.0.0.1"]
PATHS = ["/conteudo/noticia/ano-novo/", "/blog/abertas-inscricoes", "/pt/conteudo/noticia/x1", "/secao/noticias/123", "/noticias/456/", "/noticias/semana-aberta/", "/tag/eventos/", "/edital.pdf", "/secao/texto-longo-sobre", "/Noticias/7"]
LINKS = f"links AS (SELECT page_id, 'http://' || ({HOSTS})[page_id // 10 % 4 + 1] || ({PATHS})[page_id % 10 + 1] AS u, ({HOSTS})[page_id // 10 % 4 + 1] AS host, rtrim(({PATHS})[page_id % 10 + 1], '/') || '/' AS p, repeat('x', (page_id % 30)::INT) AS label, page_id % 11 = 0 AS nav, page_id % 3 = 0 AS inside, page_id % 7 AS k FROM pages)"


def link_rows(spark, sf_dir):
    pick = lambda options, at: F.get(F.lit(options), at.cast("int"))
    page = F.col("page_id")
    url = F.concat(F.lit("http://"), pick(HOSTS, F.floor(page / 10) % 4), pick(PATHS, page % 10))
    return read(spark, sf_dir, "pages").select("page_id", url.alias("u"), F.repeat(F.lit("x"), (page % 30).cast("int")).alias("label"), (page % 11 == 0).alias("nav"), (page % 3 == 0).alias("inside"), (page % 7).alias("k"))


@query(f"""WITH {LINKS} SELECT page_id, u, CASE WHEN ends_with(p, '.pdf/') OR NOT (host = '10.0.0.1' OR host = 'example.org' OR ends_with(host, '.example.org')) OR p = '/tag/eventos/' OR nav THEN NULL
WHEN regexp_matches(lower(p), '^/conteudo/noticia/[^/]+/$') THEN 'legacy_article' WHEN regexp_matches(lower(p), '^/blog/[^/]+/$') THEN 'current_wordpress_article' WHEN regexp_matches(lower(p), '/conteudo/noticia/[^/]+/') THEN 'legacy_article' WHEN regexp_matches(lower(p), '/noticias?/[^/]+/') THEN 'article_like_path'
WHEN inside AND length(label) >= 18 AND p = '/secao/texto-longo-sobre/' THEN 'article_context' END AS kind FROM links""")
def u10_news_kind(spark, sf_dir):
    kind = links.news_kind(F.col("u"), F.col("label"), F.col("nav"), F.col("inside"), "example.org", "10.0.0.1")
    return link_rows(spark, sf_dir).select("page_id", "u", kind.alias("kind"))


@query(rf"WITH {LINKS} SELECT page_id, CASE WHEN regexp_matches(p, '^/noticias/\d+/$') THEN 'numeric_news' WHEN regexp_matches(lower(p), '^/noticias/[a-z0-9-]+/$') THEN 'slug_news' WHEN regexp_matches(lower(p), '/noticias?/[^/]+/') THEN 'article_like' ELSE '' END AS kind FROM links")
def u11_old_portal_kind(spark, sf_dir):
    return link_rows(spark, sf_dir).select("page_id", links.old_portal_kind(F.col("u")).alias("kind"))


SOURCES = [("legacy", "legacy", "http://10.0.0.1/"), ("current", "current", "http://example.org/"), ("c1", "campus_wordpress", "http://old.example.org/"), ("o1", "old_subdomain_portal", "http://old.example.org/x"), ("other", "list", "http://any.example/")]


@query(f"WITH {LINKS}, s(source, kind, base_host) AS (VALUES ('legacy', 'legacy', '10.0.0.1'), ('current', 'current', 'example.org'), ('c1', 'campus_wordpress', 'old.example.org'), ('o1', 'old_subdomain_portal', 'old.example.org'), ('other', 'list', 'any.example')) SELECT page_id, source FROM links, s WHERE CASE WHEN source = 'legacy' THEN host = '10.0.0.1' AND starts_with(p, '/conteudo/noticia/') WHEN source = 'current' THEN host = 'example.org' AND starts_with(p, '/blog/') WHEN kind = 'campus_wordpress' THEN host = base_host WHEN kind = 'old_subdomain_portal' THEN host = base_host AND regexp_matches(lower(p), '^/noticias/[^/]+/$') ELSE true END")
def u13_accepted(spark, sf_dir):
    """Each source of the (fixed) list with the candidates it takes."""
    source = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), F.lit(k).alias("kind"), F.lit(b).alias("base")) for s, k, b in SOURCES)))
    rows = link_rows(spark, sf_dir).withColumn("s", source)
    return rows.where(links.accepted(F.col("u"), F.col("s.source"), F.col("s.kind"), F.col("s.base"), "10.0.0.1", "example.org")).select("page_id", "s.source")


@query(f"WITH {LINKS}, f AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'http://10.0.0.1/end' ELSE 'https://www.example.org/end' END AS final FROM links) SELECT page_id, CASE WHEN host = '10.0.0.1' THEN CASE WHEN final = 'http://10.0.0.1/end' THEN final ELSE u END ELSE coalesce(final, u) END AS base FROM f")
def u14_link_base(spark, sf_dir):
    final = F.when(F.col("k") == 0, None).when(F.col("k") == 1, "http://10.0.0.1/end").otherwise("https://www.example.org/end")
    return link_rows(spark, sf_dir).select("page_id", links.link_base(F.col("u"), final, "10.0.0.1").alias("base"))


@query("SELECT event_type, coalesce(max(value) FILTER (value > 99), 0) AS most FROM events GROUP BY 1")
def m11_maximum(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(reports.maximum(F.when(F.col("value") > 99, F.col("value"))).alias("most"))


RAW_QUESTIONS = """'[{"question":"  Which  room ' || event_id || '? ","field":""},"plain  ' || event_id || '",{"field":"who"},{"question":"When?","field":" when "},""]'"""


@query(f"""WITH r AS (SELECT event_id, unnest(CAST({RAW_QUESTIONS} AS JSON[])) AS e, generate_subscripts(CAST({RAW_QUESTIONS} AS JSON[]), 1) AS i FROM events), q AS (SELECT event_id, i, CASE WHEN json_type(e) = 'OBJECT' THEN coalesce(e->>'$.field', '') ELSE '' END AS f, CASE WHEN json_type(e) = 'OBJECT' THEN e->>'$.question' ELSE e->>'$' END AS t FROM r),
n AS (SELECT event_id, i, CASE WHEN {of(NORMAL, 'f')} = '' THEN 'type_specific' ELSE {of(NORMAL, 'f')} END AS field, {of(NORMAL, 't')} AS question FROM q) SELECT event_id, field, question FROM n WHERE question <> ''""")
def m18_questions(spark, sf_dir):
    raw = F.concat(F.lit('[{"question":"  Which  room '), F.col("event_id"), F.lit('? ","field":""},"plain  '), F.col("event_id"), F.lit('",{"field":"who"},{"question":"When?","field":" when "},""]'))
    return read(spark, sf_dir, "events").select("event_id", F.inline(questions.normalized(raw)))


_TEMPLATES = "MAP {" + ", ".join(f"'{f}': '{q}'" for f, q in cases.QUESTIONS.items()) + "}"
_FIRST = [("when", cases.QUESTIONS["when"]), ("type_specific", "What is the deadline?"), ("who", cases.QUESTIONS["when"].lower() + " ")]


@query(f"""WITH {CASE}, q AS (SELECT doc_id, removed, list_concat([{', '.join(f"{{'field': '{f}', 'question': '{t}'}}" for f, t in _FIRST)}], list_transform(list_slice(removed, 1, 2), lambda f: {{'field': f, 'question': {_TEMPLATES}[f]}})) AS asked FROM a),
k AS (SELECT *, list_transform(asked, lambda x: array_to_string({of(TOKENS, 'x.question')}, ' ')) AS keys FROM q), u AS (SELECT doc_id, removed, list_filter(asked, lambda x, i: list_position(keys, keys[i]) = i) AS kept, keys FROM k),
f AS (SELECT *, list_filter(removed, lambda m: NOT list_contains(list_transform(kept, lambda x: x.field), m) AND NOT list_contains(keys, array_to_string({of(TOKENS, _TEMPLATES + '[m]')}, ' '))) AS more FROM u)
SELECT doc_id, array_to_string(list_concat(list_transform(kept, lambda x: x.field || '=' || trim(x.question)), list_transform(more, lambda m: m || '=' || {_TEMPLATES}[m])), '|') AS merged FROM f""")
def m20_merged_questions(spark, sf_dir):
    rows = masked_cases(spark, sf_dir)
    first = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(q).alias("question")) for f, q in _FIRST))
    merged = questions.merged(first, cases.questions(F.slice("removed_fields", 1, 2)), F.col("removed_fields"), cases.QUESTIONS)
    return rows.select("doc_id", F.array_join(F.transform(merged, lambda q: F.concat(q["field"], F.lit("="), q["question"])), "|").alias("merged"))


@query("SELECT doc_id, (coalesce(text, '') <> '')::INT + (coalesce(lang, '') <> '')::INT + (coalesce(source, '') <> '')::INT + (coalesce(nullif(source, 'web'), '') <> '')::INT AS quality FROM documents")
def m24_candidate_quality(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", links.candidate_quality(F.col("text"), F.col("lang"), F.col("source"), F.nullif("source", F.lit("web"))).cast("int").alias("quality"))


_FIELDS = ["when", "source", "what", "who"]
_VALUES = f"v AS (SELECT doc_id, (['when','source','what','who'])[doc_id % 4 + 1] AS field, {of(NORMAL, 'substr(text, 1, 80)')} AS a, {of(NORMAL, 'substr(text, 41, (doc_id % 40)::INT)')} AS b FROM documents)"


def field_rows(spark, sf_dir):
    doc = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.get(F.lit(_FIELDS), (doc % 4).cast("int")).alias("field"), text.normalize_space(F.substr("text", F.lit(1), F.lit(80))).alias("a"), text.normalize_space(F.substr("text", F.lit(41), (doc % 40).cast("int"))).alias("b"))
    return rows


@query(f"WITH {_VALUES}, t AS (SELECT *, {of(CONTENT, 'a')} AS ta, {of(CONTENT, 'b')} AS tb FROM v), r AS (SELECT *, CASE WHEN len(tb) = 0 THEN 0 ELSE len(list_intersect(ta, tb))::DOUBLE / len(tb) END AS share FROM t) SELECT doc_id, (a <> '' AND b <> '' AND CASE WHEN field IN ('when', 'source') THEN contains(a, b) WHEN field = 'what' THEN share >= 0.35 ELSE share >= 0.5 OR contains(lower(a), lower(b)) END)::INT AS correct FROM r")
def f11_field_correct(spark, sf_dir):
    share = values.overlap_ratio(text.content_tokens(F.col("a")), text.content_tokens(F.col("b")))
    return field_rows(spark, sf_dir).select("doc_id", reports.field_correct(F.col("field"), F.col("a"), F.col("b"), share).alias("correct"))


@query(f"WITH {_VALUES}, t AS (SELECT *, {of(TOKENS, 'a')} AS ta, {of(TOKENS, 'b')} AS tb FROM v) SELECT doc_id, (a <> '' AND (field = 'what' OR (len(tb) > 0 AND (list_has_any(ta, tb) OR contains(a, b)))))::INT AS supported FROM t")
def f12_field_supported(spark, sf_dir):
    return field_rows(spark, sf_dir).select("doc_id", reports.field_supported(F.col("field"), F.col("a"), F.col("b"), text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("supported"))


@query(f"SELECT min(doc_id) AS doc_id, title FROM {ARTICLES} WHERE status = 'needs_review' AND title <> '' GROUP BY title ORDER BY 1 LIMIT 25")
def f14_review_examples(spark, sf_dir):
    """Different titles that need a review, at most 25: a list of examples."""
    rows = arts(spark, sf_dir).where("status = 'needs_review' and title <> ''")
    return rows.groupBy("title").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").limit(25).select("doc_id", "title")


@query("SELECT page_id % 10 AS source, bool_or(length(html) > 200) AND max(len(regexp_extract_all(html, '<a '))) > 0 AND bool_or(contains(html, '<article')) AS recommended FROM pages GROUP BY 1")
def f15_recommended(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("source"), (F.length("html") > 200).alias("opened"), F.regexp_count("html", F.lit("<a ")).alias("links"), F.contains("html", F.lit("<article")).alias("extractable"))
    return reports.recommended(rows, "source")


@query("SELECT p.conv_id, p.turn, length(o.text)::INT AS reply FROM conversations p JOIN conversations o ON o.conv_id = p.conv_id AND o.turn = p.turn + 1 WHERE p.role = 'user' AND o.role = 'assistant'")
def j3_pitch_output(spark, sf_dir):
    """Each question with what was put out for it."""
    turns = read(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn")
    given = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("reply"))
    return asked.join(given, ["conv_id", "turn"])


@query("SELECT l.doc_id, l.quality, d.source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.n_chars > 500")
def j4_source_article(spark, sf_dir):
    """Each labelled pitch with its source article, null where that is missing."""
    return read(spark, sf_dir, "labels").select("doc_id", "quality").join(read(spark, sf_dir, "documents").where("n_chars > 500").select("doc_id", "source"), "doc_id", "left")


PLAIN = f"plain AS (SELECT DISTINCT translate(title_key, 'ß', 's') AS t FROM {KEYED} WHERE title_key <> '')"


@query(f"WITH {PLAIN} SELECT x.t AS a, y.t AS b, levenshtein(x.t, y.t)::INT AS distance FROM plain x JOIN plain y ON x.t < y.t AND abs(length(x.t) - length(y.t)) <= greatest(length(x.t), length(y.t)) * 5 // 100 WHERE levenshtein(x.t, y.t) <= greatest(length(x.t), length(y.t)) * 5 // 100")
def j9_all_pairs(spark, sf_dir):
    """All pairs of alike titles, without blocks."""
    return dedupe.near_keys(keyed(spark, sf_dir).select(F.translate("title_key", "ß", "s").alias("t")), "t")


def _pairs(block: str, bound: str = "> 1") -> str:
    return f"WITH keyed AS {KEYED}, exploded AS (SELECT doc_id, unnest({block}) AS block FROM keyed WHERE title_key <> ''), sized AS (SELECT * FROM exploded WHERE block IS NOT NULL QUALIFY count(*) OVER (PARTITION BY block) {bound}) SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y ON x.block = y.block AND x.doc_id < y.doc_id"


@query(_pairs("[left(published, 4) || '|' || left(title_key, 12)]"))
def j10_bucket_pairs(spark, sf_dir):
    """Pairs that share the year and the beginning of the title."""
    key = F.concat_ws("|", F.left("published", F.lit(4)), F.left("title_key", F.lit(12)))
    return dedupe.blocked_pairs(keyed(spark, sf_dir).where("title_key <> ''"), F.array(key), single=True)


@query(_pairs("list_distinct(['title:' || left(title_key, 24), 'year_title:' || left(published, 4) || '|' || left(title_key, 18), CASE WHEN len(string_split(title_key, ' ')) >= 4 THEN 'tokens:' || array_to_string(string_split(title_key, ' ')[1:5], ' ') END])", "BETWEEN 2 AND 350"))
def j11_three_keys(spark, sf_dir):
    """Pairs by any of three keys, in blocks of 2 to 350 rows as the operator has it; j11_title_pairs has no bound."""
    words = F.split("title_key", " ")
    five = F.when(F.size(words) >= 4, F.concat(F.lit("tokens:"), F.array_join(F.slice(words, 1, 5), " ")))
    by_year = F.concat(F.lit("year_title:"), F.left("published", F.lit(4)), F.lit("|"), F.left("title_key", F.lit(18)))
    keys = F.array(F.concat(F.lit("title:"), F.left("title_key", F.lit(24))), by_year, five)
    return dedupe.blocked_pairs(keyed(spark, sf_dir).where("title_key <> ''"), keys, largest=dedupe.LARGEST_BLOCK)


_SLUG = of(KEY, "list_last(string_split(trim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), '/'))")


@query(f"""WITH k AS (SELECT page_id, {NORMALIZED} AS key, 'normalized_url' AS reason, 1.0::DOUBLE AS confidence FROM pages UNION ALL SELECT page_id, {_SLUG}, 'slug', 0.86::DOUBLE FROM pages), f AS (SELECT reason, key, min(page_id) AS src FROM k WHERE key <> '' GROUP BY ALL)
SELECT f.src, k.page_id AS dst, k.reason, k.confidence FROM k JOIN f USING (reason, key) WHERE k.page_id <> f.src""")
def j12_url_and_slug_edges(spark, sf_dir):
    u = F.col("url")
    rows = stage(read(spark, sf_dir, "pages").select("page_id", urls.normalize_url(u).alias("normalized_url"), text.text_key(urls.slug(u)).alias("slug")), "addresses")
    return dedupe.exact_edges(rows, {"normalized_url": (F.col("normalized_url"), 1.0), "slug": (F.col("slug"), 0.86)}, "page_id")


_IMAGES, _LINKS, _FILES = "contains(body, 'q')", "contains(body, 'x')", "contains(body, 'w')"


@query(f"WITH RECURSIVE {EDGES}, {REACH}, grouped AS (SELECT k.*, coalesce(root, k.doc_id) AS group_root FROM keyed k LEFT JOIN roots ON node = k.doc_id) SELECT group_root, doc_id AS canonical FROM grouped QUALIFY row_number() OVER (PARTITION BY group_root ORDER BY coalesce(status = 'collected', false) DESC, words DESC, published <> '' DESC, coalesce(unit, '') <> '' DESC, {_IMAGES} DESC, {_LINKS} DESC, CASE environment WHEN 'web' THEN 3 WHEN 'books' THEN 2 ELSE 1 END DESC, doc_id) = 1")
def w2_canonical(spark, sf_dir):
    """The canonical document of each group by all eight parts of the score."""
    rows = stage(keyed(spark, sf_dir).withColumns({"images": F.contains("body", F.lit("q")), "links": F.contains("body", F.lit("x"))}).drop("body"), "scored")
    rank = F.when(F.col("environment") == "web", 3).when(F.col("environment") == "books", 2).otherwise(1)
    score = articles.canonical_score(F.col("status"), F.col("words"), F.col("published"), F.col("unit"), F.col("images"), F.col("links"), rank)
    from .dedupe_queries import edges_of

    found = dedupe.assign_groups(rows, stage(edges_of(rows), "exact"), score)
    return found.where("is_canonical").select("group_root", F.col("doc_id").alias("canonical"))


@query("SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 ORDER BY doc_id LIMIT 30")
def w5_limited(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").where("doc_id % 2 = 0").select("doc_id", "source", F.when(F.col("doc_id") % 4 == 0, "portal").otherwise("campus").alias("environment"))
    return reports.limited(rows, "environment", "source", "doc_id", 30, "portal").select("doc_id", "source")


@query("SELECT value, n, row_number() OVER (ORDER BY n DESC, value)::INT AS place FROM (SELECT coalesce(nullif(source, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1)")
def w16_report_order(spark, sf_dir):
    from ..operators import profile

    return reports.ranked(profile.counts(read(spark, sf_dir, "documents"), "source"), "n", "value")


@query("SELECT lang, source AS best, n FROM (SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, chars DESC, source DESC) = 1")
def w17_best(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return reports.best(rows, ["lang"], "source", "n", "chars", "source")


_WANTED, _SHUNNED = ["the", "die", "que", "les"], ["of", "der", "con"]


@query(f"WITH t AS (SELECT doc_id, text, list_distinct({TOKENS}) AS t FROM documents), s AS (SELECT doc_id, (5 * len(list_intersect(t, {_WANTED})) - 6 * len(list_intersect(t, {_SHUNNED})) + 4 * (NOT contains(coalesce(text, ''), 'q'))::INT + 2 * (length(coalesce(text, '')) <= 520)::INT + (len(t) >= 50)::INT)::INT AS score FROM t) SELECT doc_id, score FROM s ORDER BY score DESC, doc_id::VARCHAR DESC LIMIT 1")
def w18_example_case(spark, sf_dir):
    body = F.coalesce("text", F.lit(""))
    rows = read(spark, sf_dir, "documents").select("doc_id", body.alias("text"), F.array_distinct(text.tokens(F.col("text"))).alias("t"))
    score = reports.example_score(F.col("t"), _WANTED, _SHUNNED, ~F.contains("text", F.lit("q")), F.length("text") <= 520, F.size("t") >= 50)
    return rows.select("doc_id", score.alias("score")).orderBy(F.desc("score"), F.col("doc_id").cast("string").desc()).limit(1)


@query(f"SELECT coalesce(status, 'none') AS status, doc_id, title, row_number() OVER (PARTITION BY coalesce(status, 'none') ORDER BY doc_id)::INT AS place FROM {ARTICLES} QUALIFY place <= 5")
def w19_examples(spark, sf_dir):
    rows = arts(spark, sf_dir).select(F.coalesce("status", F.lit("none")).alias("status"), "doc_id", "title")
    return reports.examples(rows, "status", "doc_id")


@query("SELECT unnest(range(1, 9))::INT AS position, unnest(['doc_id', 'text', 'lang', 'source', 'n_chars', 'page_id', 'url', 'html']) AS field")
def o2_ordered_fields(spark, sf_dir):
    fields = reports.ordered_fields(*(read(spark, sf_dir, t).columns for t in ("documents", "pages", "documents")))
    return spark.createDataFrame(list(enumerate(fields, 1)), "position int, field string")


FLAGGED = f"flagged AS (SELECT *, {_IMAGES} AS images, {_LINKS} AS links, {_FILES} AS attachments FROM {ARTICLES})"


def flagged(spark, sf_dir):
    return arts(spark, sf_dir).withColumns({name: F.contains("body", F.lit(mark)) for name, mark in (("images", "q"), ("links", "x"), ("attachments", "w"))})


def _tall(metrics: dict[str, str], rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, ({e})::DOUBLE AS value FROM {rows}" for name, e in metrics.items())


@query(f"WITH {FLAGGED} " + _tall({
    "total_attempted": "count(*)", "total_collected": "count_if(status = 'collected')", "total_needs_review": "count_if(status = 'needs_review')", "total_errors": "count_if(status = 'error')", "total_with_title": "count_if(coalesce(title, '') <> '')", "total_with_body": "count_if(coalesce(body, '') <> '')",
    "total_with_publication_date": "count_if(published <> '')", "total_with_author_or_publisher": "count_if(coalesce(unit, '') <> '')", "total_with_images": "count_if(images)", "total_with_links": "count_if(links)", "total_with_attachments": "count_if(attachments)", "average_word_count": "coalesce(round(avg(words), 2), 0)",
}, "flagged"))
def a8_crawl_report(spark, sf_dir):
    return reports.crawl_report(flagged(spark, sf_dir).withColumnRenamed("unit", "author"))


@query(f"WITH n AS (SELECT page_id % 10 AS source, page_id // 10 AS page, {NORMALIZED} AS u FROM pages) SELECT source, count(DISTINCT page) AS pages, count(u) AS urls, count(DISTINCT u) AS unique_urls, count(u) - count(DISTINCT u) AS merged FROM n GROUP BY 1")
def a9_discovery_report(spark, sf_dir):
    page = F.col("page_id")
    rows = read(spark, sf_dir, "pages").select((page % 10).alias("source"), F.floor(page / 10).alias("page"), urls.normalize_url(F.col("url")).alias("u"))
    return reports.discovery_report(rows, "source", "page", "u")


@query(r"WITH i AS (SELECT CASE WHEN page_id % 3 = 0 THEN '2024' ELSE '' END AS date, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '\.pdf')) AS documents, length(html) AS words FROM pages) " + _tall({"inspected": "count(*)", "with_normalized_date": "count_if(date <> '')", "with_links": "count_if(links > 0)", "with_document_like_links": "count_if(documents > 0)", "average_word_count": "coalesce(round(avg(words), 2), 0)", "median_word_count": "coalesce(round(median(words), 2), 0)"}, "i"))
def a10_inspection_summary(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 == 0, "2024").otherwise("").alias("date"), F.regexp_count("html", F.lit("<a ")).alias("links"), F.regexp_count("html", F.lit(r"\.pdf")).alias("documents"), F.length("html").alias("words"))
    return reports.inspection_summary(rows)


_READY = f"(SELECT * FROM flagged WHERE coalesce(status, 'collected') = 'collected' AND trim(body) <> '' AND words >= 30)"


@query(f"WITH {FLAGGED} SELECT 'full_records' AS metric, count(*)::DOUBLE AS value FROM flagged UNION ALL " + _tall({"canonical_model_ready_records": "count(*)", "avg_word_count": "round(avg(words), 2)", "median_word_count": "round(median(words), 2)", "with_links": "count_if(links)", "with_attachments": "count_if(attachments)", "with_images": "count_if(images)"}, _READY))
def a14_dataset_summary(spark, sf_dir):
    rows = flagged(spark, sf_dir)
    return reports.dataset_summary(rows, articles.model_ready(rows))


@query(f"SELECT left(published, 4) AS value, count(*) AS n FROM {ARTICLES} WHERE published <> '' GROUP BY 1")
def a14_by_year(spark, sf_dir):
    return arts(spark, sf_dir).where("published <> ''").groupBy(F.left("published", F.lit(4)).alias("value")).agg(F.count("*").alias("n"))


_DIGITS = {"completeness": 4, "factual_precision": 4, "hallucination_rate": 4, "question_relevance": 4, "question_coverage": 4}


@query(f"WITH {SCORED} SELECT configuration, count(*) AS cases, {', '.join(f'round(avg({m}), {n}) AS {m}' for m, n in _DIGITS.items())} FROM sc GROUP BY 1")
def a16_by_configuration(spark, sf_dir):
    return reports.aggregate(scored(spark, sf_dir), "configuration", _DIGITS)


@query(f"WITH {SCORED}, n AS (SELECT * REPLACE (CASE WHEN case_id % 7 <> 0 AND configuration <> 'direct' THEN question_coverage END AS question_coverage) FROM sc) SELECT configuration, count(*) AS cases, round(avg(completeness), 4) AS completeness, round(avg(question_relevance), 2) AS question_relevance, round(avg(question_coverage), 4) AS question_coverage FROM n GROUP BY 1")
def a18_strict_aggregate(spark, sf_dir):
    """A measure that some cases lack, and one configuration altogether."""
    present = (F.col("case_id") % 7 != 0) & (F.col("configuration") != "direct")
    rows = scored(spark, sf_dir).withColumn("question_coverage", F.when(present, F.col("question_coverage")))
    return reports.aggregate(rows, "configuration", {"completeness": 4, "question_relevance": 2, "question_coverage": 4})


@query("""WITH r AS (SELECT event_type, event_id % 50 <> 0 AS ok, event_id % 70 <> 0 AS parsed, event_id % 100 AS p, event_id % 40 AS g, CASE WHEN event_id % 9 <> 0 THEN (event_id % 1000) * 1000000 END AS ns, value, event_id FROM events), s AS (SELECT *, CASE WHEN ok AND ns <> 0 THEN ns / 1000000000.0::DOUBLE END AS sec FROM r)
SELECT event_type, count_if(ok)::BIGINT AS successful_requests, count_if(NOT ok)::BIGINT AS failures, count_if(NOT parsed)::BIGINT AS parse_failures, count(*)::DOUBLE AS wall_seconds, round(count_if(ok) * 60 / count(*)::DOUBLE, 4) AS requests_per_minute, coalesce(sum(p) FILTER (ok), 0)::BIGINT AS prompt_tokens, coalesce(sum(g) FILTER (ok), 0)::BIGINT AS generated_tokens,
coalesce(round(avg(sec), 4), 0) AS mean_native_request_seconds, coalesce(round(quantile_disc(sec, 0.95), 4), 0) AS p95_native_request_seconds, coalesce(max(value), 0) AS peak_vram_mib, coalesce(max(value) FILTER (event_id % 2 = 0), 0) AS peak_gpu_utilization_percent FROM s GROUP BY 1""")
def a21_benchmark(spark, sf_dir):
    e = F.col("event_id")
    native = F.when(e % 9 != 0, (e % 1000) * 1_000_000)
    rows = read(spark, sf_dir, "events").select("event_type", (e % 50 != 0).alias("ok"), (e % 70 != 0).alias("parsed"), (e % 100).alias("prompt_tokens"), (e % 40).alias("generated_tokens"), native.alias("native_ns"), F.col("value").alias("memory"), F.when(e % 2 == 0, F.col("value")).alias("utilization"))
    return reports.benchmark(rows, "event_type", F.count("*").cast("double"))


@query(f"WITH {SCORED} SELECT configuration, count(DISTINCT case_id) AS cases FROM sc GROUP BY 1")
def a29_cases(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("configuration").agg(F.count_distinct("case_id").alias("cases"))


@query("SELECT page_id % 10 AS source, count(*) AS pages, sum(len(regexp_extract_all(html, '<a ')))::BIGINT AS urls, count(DISTINCT url) AS unique_urls FROM pages GROUP BY 1")
def a31_source_counters(spark, sf_dir):
    rows = read(spark, sf_dir, "pages")
    return rows.groupBy((F.col("page_id") % 10).alias("source")).agg(F.count("*").alias("pages"), F.sum(F.regexp_count("html", F.lit("<a "))).alias("urls"), F.count_distinct("url").alias("unique_urls"))


@query(f"WITH RECURSIVE {EDGES}, {REACH}, {GROUPED} SELECT doc_id FROM grouped QUALIFY row_number() OVER (PARTITION BY group_root ORDER BY words DESC, doc_id) = 1")
def src8_canonical(spark, sf_dir):
    """The canonical view of the corpus; the full one is the table itself."""
    return articles.view(grouped(spark, sf_dir)[0], canonical=True).select("doc_id")


@query("SELECT DISTINCT s || h || t AS url FROM (VALUES ('http://'), ('https://')) a(s), (VALUES ('old.example.org'), ('www.example.org'), ('extra.example.org')) b(h), (VALUES ('/'), ('/noticias/'), ('/?page=2')) c(t)")
def src15_diagnostic_urls(spark, sf_dir):
    return crawl.diagnostic_urls(spark, ["old.example.org", "www.example.org", "old.example.org"], ["/", "/noticias/", "/?page=2"], ["extra.example.org"])


@query(r"SELECT page_id, trim(regexp_extract('Notícia - publicado por:  Unit ' || (page_id % 9) || ' / 2024', '(?i)publicado por:\s*([^/]+)', 1)) AS publisher FROM pages")
def h13_publisher(spark, sf_dir):
    body = F.concat(F.lit("Notícia - publicado por:  Unit "), F.col("page_id") % 9, F.lit(" / 2024"))
    return read(spark, sf_dir, "pages").select("page_id", text.publisher(body).alias("publisher"))


@query("SELECT page_id, url, 'error' AS status, 'not fetched' AS error_message, 0 AS words FROM pages WHERE page_id % 9 = 0")
def h9_error_articles(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return reports.error_articles(pages.select("page_id", "url"), pages.where("page_id % 9 <> 0"), "page_id")
