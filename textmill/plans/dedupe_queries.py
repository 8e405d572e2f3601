"""Duplicates of documents: edges, components, canonical documents, groups, consolidation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import articles, dedupe, graph
from ..sources.scratch import stage
from .corpus_queries import ARTICLES, arts
from .registry import query, read
from .text_queries import KEY, NORMAL

KEYED = f"(SELECT a.*, CASE WHEN {NORMAL.replace('coalesce(text', 'coalesce(body')} = '' THEN '' ELSE sha256({NORMAL.replace('coalesce(text', 'coalesce(body')}) END AS content_hash, {KEY.replace('coalesce(text', 'coalesce(title')} AS title_key FROM {ARTICLES} a)"
EDGES = f"""keyed AS {KEYED}, families AS (SELECT doc_id, content_hash AS key, 'content_hash' AS reason, 1.0::DOUBLE AS confidence FROM keyed UNION ALL SELECT doc_id, title_key || '|' || unit AS key, 'title_unit', 0.95::DOUBLE FROM keyed WHERE title_key <> ''),
firsts AS (SELECT reason, key, min(doc_id) AS src FROM families WHERE key <> '' GROUP BY ALL), edges AS (SELECT f.src, k.doc_id AS dst, k.reason, k.confidence FROM families k JOIN firsts f USING (reason, key) WHERE k.doc_id <> f.src)"""
REACH = """both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), reach(node, other) AS (SELECT DISTINCT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON b.src = r.other), roots AS (SELECT node, min(other) AS root FROM reach GROUP BY 1)"""
GROUPED = """grouped AS (SELECT k.doc_id, k.words, k.environment, coalesce(root, k.doc_id) AS group_root FROM keyed k LEFT JOIN roots ON node = k.doc_id)"""


def keyed(spark, sf_dir):
    return arts(spark, sf_dir).withColumns({"content_hash": text.text_hash(F.col("body")), "title_key": text.text_key(F.col("title"))})


def edges_of(rows):
    by_title = F.when(F.col("title_key") != "", F.concat_ws("|", "title_key", "unit")).otherwise("")
    rows = stage(rows.select("doc_id", "content_hash", "title_key", "unit"), "keys")  # narrow: keys of whole texts are made once
    return dedupe.exact_edges(rows, {"content_hash": (F.col("content_hash"), 1.0), "title_unit": (by_title, 0.95)})


@query(f"WITH {EDGES} SELECT src, dst, reason, confidence FROM edges")
def j12_exact_edges(spark, sf_dir):
    return edges_of(keyed(spark, sf_dir))


@query(f"WITH RECURSIVE {EDGES}, {REACH} SELECT node, root FROM roots")
def c2_components(spark, sf_dir):
    return graph.components(edges_of(keyed(spark, sf_dir)))


def grouped(spark, sf_dir):
    rows = keyed(spark, sf_dir)
    edges = stage(edges_of(rows), "exact")
    return dedupe.assign_groups(rows.select("doc_id", "words", "environment"), edges, [F.col("words")]), edges


@query(f"WITH RECURSIVE {EDGES}, {REACH}, {GROUPED} SELECT doc_id, group_root, count(*) OVER (PARTITION BY group_root) AS group_size, row_number() OVER (PARTITION BY group_root ORDER BY words DESC, doc_id) = 1 AS is_canonical FROM grouped")
def c1_exact_dedupe(spark, sf_dir):
    return grouped(spark, sf_dir)[0].select("doc_id", "group_root", "group_size", "is_canonical")


@query(f"""WITH RECURSIVE {EDGES}, {REACH}, {GROUPED}, members AS (SELECT group_root, count(*) AS size, min(doc_id) AS first, arg_max(doc_id, (words, -doc_id)) AS canonical, array_to_string(list_sort(list(doc_id)), ',') AS members, count(DISTINCT environment) > 1 AS cross_source FROM grouped GROUP BY 1 HAVING count(*) > 1),
why AS (SELECT group_root, max(confidence) AS confidence, array_to_string(list_sort(list_distinct(list(reason))), ';') AS reasons FROM edges JOIN grouped ON doc_id = dst GROUP BY 1)
SELECT printf('dup_%08d', row_number() OVER (ORDER BY first)) AS group_id, canonical, size, confidence, reasons, members, cross_source FROM members JOIN why USING (group_root)""")
def a23_duplicate_groups(spark, sf_dir):
    return listed(*grouped(spark, sf_dir))


def listed(rows, edges):
    found = dedupe.group_table(stage(rows, "grouped"), edges)
    return found.select("group_id", "canonical", "size", "confidence", F.array_join("reasons", ";").alias("reasons"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "cross_source")


BLOCKS = "list_distinct([left(published, 4) || '|' || left(title_key, 12), unit || '|' || left(title_key, 16)])"


def block_keys():
    return F.array(F.concat_ws("|", F.left("published", F.lit(4)), F.left("title_key", F.lit(12))), F.concat_ws("|", "unit", F.left("title_key", F.lit(16))))


CANDIDATES = "['title:' || left(title_key, 24), CASE WHEN len(string_split(title_key, ' ')) >= 4 THEN 'words:' || array_to_string(string_split(title_key, ' ')[1:5], ' ') END, 'year:' || left(published, 4) || '|' || left(title_key, 12), 'unit:' || unit || '|' || left(title_key, 16)]"
TITLE_PAIRS = f"keyed AS {KEYED}, titles AS (SELECT title_key, min(doc_id) AS first, count(*) AS n FROM keyed WHERE title_key <> '' GROUP BY 1), blocks AS (SELECT DISTINCT title_key, unnest({CANDIDATES}) AS block FROM keyed WHERE title_key <> ''), title_pairs AS (SELECT DISTINCT x.title_key AS x_key, y.title_key AS y_key FROM blocks x JOIN blocks y ON x.block = y.block AND x.title_key < y.title_key), both_titles AS (SELECT least(x.first, y.first) AS a, greatest(x.first, y.first) AS b, CASE WHEN x.first < y.first THEN x.n ELSE y.n END AS a_rows, CASE WHEN x.first < y.first THEN y.n ELSE x.n END AS b_rows, translate(x_key, 'ß', 's') AS x_plain, translate(y_key, 'ß', 's') AS y_plain FROM title_pairs JOIN titles x ON x.title_key = x_key JOIN titles y ON y.title_key = y_key)"


def candidate_keys():
    """The title alone (24 characters, five words), and the keys of block_keys; null where one does not apply."""
    words = F.split("title_key", " ")
    five = F.when(F.size(words) >= 4, F.concat(F.lit("words:"), F.array_join(F.slice(words, 1, 5), " ")))
    of_year = F.concat(F.lit("year:"), F.left("published", F.lit(4)), F.lit("|"), F.left("title_key", F.lit(12)))
    return F.array(F.concat(F.lit("title:"), F.left("title_key", F.lit(24))), five, of_year, F.concat(F.lit("unit:"), "unit", F.lit("|"), F.left("title_key", F.lit(16))))


BLOCKED = f"keyed AS {KEYED}, exploded AS (SELECT doc_id, unnest({BLOCKS}) AS block FROM keyed WHERE title_key <> ''), sized AS (SELECT * FROM exploded QUALIFY count(*) OVER (PARTITION BY block) BETWEEN 2 AND 350), pairs AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM sized x JOIN sized y ON x.block = y.block AND x.doc_id < y.doc_id)"


@query(f"WITH {BLOCKED} SELECT a, b FROM pairs")
def j11_blocked_pairs(spark, sf_dir):
    return dedupe.blocked_pairs(keyed(spark, sf_dir).where("title_key <> ''"), block_keys(), largest=dedupe.LARGEST_BLOCK)


@query(f"WITH keyed AS {KEYED}, exploded AS (SELECT unnest({BLOCKS}) AS block FROM keyed WHERE title_key <> '') SELECT block, count(*) AS n FROM exploded GROUP BY 1 HAVING count(*) > 350")
def j11_oversized_blocks(spark, sf_dir):
    """What the bound in the SQL of j11_blocked_pairs and c1_fuzzy_levenshtein leaves out there; c1_fuzzy_indel has no bound."""
    return dedupe.oversized_blocks(keyed(spark, sf_dir).where("title_key <> ''"), block_keys())


def titles_and_pairs(spark, sf_dir):
    return dedupe.title_pairs(keyed(spark, sf_dir).where("title_key <> ''"), candidate_keys(), "title_key")


@query(f"WITH {TITLE_PAIRS} SELECT a, b, a_rows, b_rows FROM both_titles")
def j11_title_pairs(spark, sf_dir):
    """Different titles that share a block, by their smallest documents, without a bound; equal titles go without saying."""
    return titles_and_pairs(spark, sf_dir).select("a", "b", "a_rows", "b_rows")


@query(f"WITH {TITLE_PAIRS} SELECT a, b, a_rows, b_rows, round(1 - levenshtein(x_plain, y_plain)::DOUBLE / greatest(length(x_plain), length(y_plain)), 4) AS score FROM both_titles WHERE levenshtein(x_plain, y_plain) <= 0.1 * greatest(length(x_plain), length(y_plain))")
def c1_title_levenshtein(spark, sf_dir):
    both = titles_and_pairs(spark, sf_dir).withColumns({s: F.translate(f"{s}_title", "ß", "s") for s in "ab"} | {"first": F.col("a"), "second": F.col("b")})
    longest, distance = F.greatest(F.length("a"), F.length("b")), F.levenshtein("a", "b")
    return both.where(distance <= 0.1 * longest).select(F.col("first").alias("a"), F.col("second").alias("b"), "a_rows", "b_rows", F.round(1 - distance / longest, 4).alias("score"))


@query(f"WITH {BLOCKED} SELECT a, b, round(1 - levenshtein(translate(x.title_key, 'ß', 's'), translate(y.title_key, 'ß', 's'))::DOUBLE / greatest(length(x.title_key), length(y.title_key)), 4) AS score FROM pairs JOIN keyed x ON x.doc_id = a JOIN keyed y ON y.doc_id = b WHERE levenshtein(translate(x.title_key, 'ß', 's'), translate(y.title_key, 'ß', 's')) <= 0.1 * greatest(length(x.title_key), length(y.title_key))")
def c1_fuzzy_levenshtein(spark, sf_dir):
    rows = keyed(spark, sf_dir).where("title_key <> ''")
    side = lambda s: rows.select(F.col("doc_id").alias(s), F.translate("title_key", "ß", "s").alias(f"{s}_key"))
    both = dedupe.blocked_pairs(rows, block_keys(), largest=dedupe.LARGEST_BLOCK).join(side("a"), "a").join(side("b"), "b")
    longest, distance = F.greatest(F.length("a_key"), F.length("b_key")), F.levenshtein("a_key", "b_key")
    return both.where(distance <= 0.1 * longest).select("a", "b", F.round(1 - distance / longest, 4).alias("score"))


@query()
def c1_fuzzy_indel(spark, sf_dir):
    rows = keyed(spark, sf_dir).withColumn("ok", articles.dedupable(F.col("status"), F.col("words"), F.col("body")))
    return dedupe.near_edges(rows, candidate_keys(), "title_key", "body", "ok", "published")


def grouped_near(spark, sf_dir):
    """Groups by exact and near edges together."""
    rows = stage(keyed(spark, sf_dir).withColumn("ok", articles.dedupable(F.col("status"), F.col("words"), F.col("body"))), "keyed")
    edges = stage(edges_of(rows).union(dedupe.near_edges(rows, candidate_keys(), "title_key", "body", "ok", "published")), "all")
    return dedupe.assign_groups(rows.select("doc_id", "words", "environment"), edges, [F.col("words")]), edges


@query()
def c1_dedupe(spark, sf_dir):
    return grouped_near(spark, sf_dir)[0].select("doc_id", "group_root", "group_size", "is_canonical")


@query()
def a23_near_duplicate_groups(spark, sf_dir):
    return listed(*grouped_near(spark, sf_dir))


@query("""WITH u AS (SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS dataset, sha256(coalesce(text, '')) AS h FROM documents), g AS (SELECT *, printf('gart_%08d', row_number() OVER (ORDER BY dataset, doc_id)) AS global_id FROM u)
SELECT global_id, doc_id AS original_id, dataset, min(global_id) OVER (PARTITION BY h) AS group_first, count(*) OVER (PARTITION BY h) AS group_size FROM g""")
def c3_consolidate(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    united = stage(dedupe.consolidate({"even": docs.where("doc_id % 2 = 0"), "odd": docs.where("doc_id % 2 = 1")}, "doc_id"), "united")
    groups = united.groupBy("h").agg(F.min("global_id").alias("group_first"), F.count("*").alias("group_size"))
    return united.join(groups, "h").select("global_id", "original_id", "dataset", "group_first", "group_size")


@query("SELECT sha256(coalesce(text, '')) AS h, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(DISTINCT source) >= 2")
def a24_cross_dataset(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"))
    return docs.groupBy("h").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id")).where("sources >= 2")
