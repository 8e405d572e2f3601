"""Filters, profiles, samples, joins and set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import text, values
from ..operators import articles, profile, sampling
from .registry import query, read

WORDS = r"len(regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+'))::INT"
STATUS = "CASE WHEN doc_id % 17 = 0 THEN 'needs_review' WHEN doc_id % 23 = 0 THEN NULL ELSE 'collected' END"
TITLE = r"left(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')), 120)"
ARTICLES = f"(SELECT doc_id, printf('art_%08d', doc_id) AS article_id, {TITLE} AS title, text AS body, source AS environment, lang AS unit, strftime(DATE '2021-01-01' + (doc_id % 1500)::INT, '%Y-%m-%d') AS published, {WORDS} AS words, {STATUS} AS status FROM documents)"


def arts(spark, sf_dir):
    return articles.from_documents(read(spark, sf_dir, "documents"))


def hashed(seed: int, key: str) -> str:
    return f"sha256('{seed}:' || {key}::VARCHAR)"


@query(f"SELECT doc_id, article_id, words FROM {ARTICLES} WHERE coalesce(status, 'collected') = 'collected' AND trim(body) <> '' AND words >= 30")
def f2_model_ready(spark, sf_dir):
    return articles.model_ready(arts(spark, sf_dir)).select("doc_id", "article_id", "words")


@query(f"SELECT doc_id, title, unit FROM {ARTICLES} WHERE coalesce(status, 'collected') = 'collected' AND trim(body) <> '' AND trim(title) <> '' AND unit <> '' AND words >= 80")
def f3_usable(spark, sf_dir):
    return articles.usable(arts(spark, sf_dir)).select("doc_id", "title", "unit")


@query(f"SELECT doc_id, coalesce(status, 'collected') = 'collected' AND words >= 50 AND length(trim(body)) >= 200 AS dedupable FROM {ARTICLES}")
def f5_dedupable(spark, sf_dir):
    return arts(spark, sf_dir).select("doc_id", articles.dedupable(F.col("status"), F.col("words"), F.col("body")).alias("dedupable"))


@query("""WITH l AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'other' ELSE lang END AS label FROM documents JOIN labels USING (doc_id)), c AS (SELECT label, count(*) AS n FROM l GROUP BY 1 HAVING count(*) >= 8)
SELECT doc_id, label FROM l WHERE label IN (SELECT label FROM c WHERE NOT (label = 'other' AND n > 0.45 * (SELECT sum(n) FROM c) AND (SELECT count(*) FROM c) > 2))""")
def f7_training_frame(spark, sf_dir):
    labelled = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("lang") == "en", "other").otherwise(F.col("lang")).alias("label"))
    return articles.training_frame(labelled, "label").select("doc_id", "label")


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def a1_counts(spark, sf_dir):
    return profile.counts(read(spark, sf_dir, "documents"), "source")


@query("SELECT coalesce(nullif(user_id::VARCHAR, ''), 'unknown') AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a2_top20(spark, sf_dir):
    return profile.top(read(spark, sf_dir, "events"), "user_id")


@query(r"SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS value FROM documents) GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def a3_top_terms(spark, sf_dir):
    return profile.top_terms(read(spark, sf_dir, "documents").select(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w+"), F.lit(0)).alias("terms")), "terms")


@query(f"WITH a AS {ARTICLES} SELECT 'environment' AS dimension, coalesce(environment, 'unknown') AS value, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'unit', coalesce(unit, 'unknown'), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'year', left(published, 4), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'month', left(published, 7), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*) FROM a GROUP BY ALL UNION ALL SELECT 'total', '', count(*) FROM a")
def a4_dataset_profile(spark, sf_dir):
    rows = arts(spark, sf_dir).select("environment", "unit", F.left("published", F.lit(4)).alias("year"), F.left("published", F.lit(7)).alias("month"), "status")
    return profile.breakdown(rows, ["environment", "unit", "year", "month", "status"])


@query(f"SELECT coalesce(round(avg(words), 2), 0.0)::DOUBLE AS avg, coalesce(median(words), 0)::DOUBLE AS median, min(words)::BIGINT AS min, max(words)::BIGINT AS max FROM {ARTICLES}")
def a6_word_stats(spark, sf_dir):
    return profile.word_stats(arts(spark, sf_dir), "words")


@query(f"WITH a AS {ARTICLES} SELECT 'title' AS field, round(100.0 * count_if(title <> '') / count(*), 2)::DOUBLE AS percent FROM a UNION ALL SELECT 'status', round(100.0 * count_if(status IS NOT NULL) / count(*), 2)::DOUBLE FROM a UNION ALL SELECT 'long_body', round(100.0 * count_if(words >= 200) / count(*), 2)::DOUBLE FROM a")
def a7_coverage(spark, sf_dir):
    return profile.coverage(arts(spark, sf_dir), {"title": F.col("title") != "", "status": F.col("status").isNotNull(), "long_body": F.col("words") >= 200})


@query("SELECT event_type, count(*) AS requests, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def a21_request_report(spark, sf_dir):
    return profile.request_report(read(spark, sf_dir, "events"), "event_type", "value")


@query(f"WITH r AS (SELECT title AS original, unit, environment, doc_id FROM {ARTICLES}) SELECT unit, environment, count(*) AS n, min_by(original, doc_id) AS example, min(doc_id) AS first_id FROM r GROUP BY 1, 2")
def a12_unit_report(spark, sf_dir):
    return arts(spark, sf_dir).groupBy("unit", "environment").agg(F.count("*").alias("n"), F.min_by("title", "doc_id").alias("example"), F.min("doc_id").alias("first_id"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM documents GROUP BY 1")
def a15_distribution(spark, sf_dir):
    return profile.distribution(read(spark, sf_dir, "documents"), "lang")


@query("SELECT event_type, round(avg(value), 4) AS value, round(avg(CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END), 4) AS some FROM events GROUP BY 1")
def a17_group_means(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumn("some", F.when(F.col("user_id") % 3 != 0, F.col("value")))
    return profile.group_means(rows, "event_type", ["value", "some"])


@query("""WITH r AS (SELECT 1 + event_id % 2 AS parallelism, count(*)::DOUBLE * CASE WHEN event_id % 2 = 1 THEN 1.2 ELSE 1 END AS rpm, 7000.0 AS vram, 0 AS failures FROM events GROUP BY event_id % 2)
SELECT CASE WHEN max(CASE WHEN parallelism = 2 THEN rpm END) >= 1.15 * max(CASE WHEN parallelism = 1 THEN rpm END) THEN 2 ELSE 1 END::INT AS parallelism, round(max(CASE WHEN parallelism = 2 THEN rpm END) / max(CASE WHEN parallelism = 1 THEN rpm END), 4) AS gain FROM r""")
def c34_select_parallelism(spark, sf_dir):
    runs = read(spark, sf_dir, "events").groupBy((1 + F.col("event_id") % 2).alias("parallelism")).agg((F.count("*").cast("double") * F.when(F.col("parallelism") == 2, 1.2).otherwise(1.0)).alias("rpm"))
    return profile.select_parallelism(runs.withColumns({"vram": F.lit(7000.0), "failures": F.lit(0)}))


@query("SELECT printf('model_%08d', row_number() OVER (ORDER BY doc_id)) AS record_id, doc_id FROM documents")
def w1_surrogate_id(spark, sf_dir):
    return sampling.numbered(read(spark, sf_dir, "documents").select("doc_id"), "model", ["doc_id"], "record_id")


@query("SELECT doc_id, source, turn::INT AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents) ORDER BY turn, source LIMIT 50")
def w4_round_robin(spark, sf_dir):
    return sampling.round_robin(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50)


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1")
def w9_best_attempt(spark, sf_dir):
    return sampling.best(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", F.desc("value"), F.asc("event_id"))


@query(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {hashed(42, 'doc_id')}) > floor(90.0 / (SELECT count(DISTINCT lang) FROM documents)) AS late FROM documents) ORDER BY late, {hashed(42, 'doc_id')} LIMIT 90")
def w10_stratified(spark, sf_dir):
    return sampling.stratified(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 90, 42, "doc_id")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) <= 10")
def w11_balanced(spark, sf_dir):
    return sampling.balanced(read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "lang", 10, F.col("n_chars"), "doc_id").drop("n_chars")


@query(f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {hashed(42, 'doc_id')}) <= 12")
def w12_equal_groups(spark, sf_dir):
    return sampling.equal_groups(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 12, 42, "doc_id")


@query(f"SELECT doc_id FROM documents ORDER BY {hashed(7, 'doc_id')} LIMIT 100")
def w13_sample(spark, sf_dir):
    return sampling.sample(read(spark, sf_dir, "documents").select("doc_id"), 100, 7, "doc_id")


@query(f"SELECT doc_id, lang, CASE WHEN pos < 0.7 THEN 'train' WHEN pos < 0.85 THEN 'validation' ELSE 'test' END AS part FROM (SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY {hashed(42, 'doc_id')}) - 1)::DOUBLE / count(*) OVER (PARTITION BY lang) AS pos FROM documents)")
def w14_split(spark, sf_dir):
    return sampling.split(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 42, "doc_id", {"train": 0.7, "validation": 0.15, "test": 0.15})


@query("SELECT doc_id, [2,3,4,5][((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 4 + 1)::INT]::INT AS depth FROM documents")
def w20_cyclic_depth(spark, sf_dir):
    return sampling.cyclic(read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", [2, 3, 4, 5], "depth").drop("lang")


@query("SELECT e.event_id, e.user_id, c.c_name, n.n_name FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def j1_source_dimension(spark, sf_dir):
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # 25 nations by definition of the table
    return read(spark, sf_dir, "events").join(people, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", "user_id", "c_name", "n_name")


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, printf('gart_%08d', row_number() OVER (ORDER BY o_orderkey)) AS global_id FROM orders)
SELECT l.l_orderkey, l.l_linenumber, CASE WHEN l.l_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS dataset, coalesce(p.global_id, '') AS global_id FROM lineitem l LEFT JOIN p ON p.o_orderkey = l.l_orderkey AND p.dataset = CASE WHEN l.l_orderkey % 2 = 0 THEN 'a' ELSE 'b' END""")
def j2_rekey_children(spark, sf_dir):
    dataset = lambda c: F.when(F.col(c) % 2 == 0, "a").otherwise("b").alias("dataset")
    parents = sampling.numbered(read(spark, sf_dir, "orders").select("o_orderkey", dataset("o_orderkey")), "gart", ["o_orderkey"], "global_id").withColumnRenamed("o_orderkey", "l_orderkey")
    children = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", dataset("l_orderkey"))
    return children.join(parents, ["dataset", "l_orderkey"], "left").select("l_orderkey", "l_linenumber", "dataset", F.coalesce("global_id", F.lit("")).alias("global_id"))


@query("SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 97 = 0 AND d.user_id = e.user_id) AND NOT EXISTS (SELECT 1 FROM events d WHERE d.event_id % 7 = 0 AND d.event_id = e.event_id)")
def j5_resume_skip(spark, sf_dir):
    """Two anti-joins in place of a join on either key."""
    events = read(spark, sf_dir, "events")
    done = events.where("event_id % 97 = 0").select("user_id").distinct()
    return events.join(done, "user_id", "left_anti").join(events.where("event_id % 7 = 0").select("event_id"), "event_id", "left_anti").select("event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j6_exclude_pilot(spark, sf_dir):
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


@query("SELECT 'selected_in_pilot' AS check_name, count(*) AS offending FROM documents WHERE doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'selected_unlabelled', count(*) FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def j8_leak_audit(spark, sf_dir):
    chosen, pilot = read(spark, sf_dir, "documents").where("doc_id % 3 = 0").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.agg(F.count("*").alias("offending")).select(F.lit(name).alias("check_name"), "offending")
    return count(chosen.join(pilot, "doc_id", "left_semi"), "selected_in_pilot").union(count(chosen.join(pilot, "doc_id", "left_anti"), "selected_unlabelled"))


@query("WITH f AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), c AS (SELECT source, lang, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL) SELECT f.source, f.lang, f.n AS count_full, coalesce(c.n, 0) AS count_canonical FROM f LEFT JOIN c ON c.source = f.source AND c.lang = f.lang")
def j19_report_join(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    full = docs.groupBy("source", "lang").agg(F.count("*").alias("count_full"))
    return full.join(docs.where("doc_id % 2 = 0").groupBy("source", "lang").agg(F.count("*").alias("n")), ["source", "lang"], "left").select("source", "lang", "count_full", F.coalesce("n", F.lit(0)).alias("count_canonical"))


@query("SELECT doc_id, source, NULL::INT AS quality, 'documents' AS dataset FROM documents UNION ALL SELECT doc_id, NULL, quality, 'labels' FROM labels")
def o1_union_provenance(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source").withColumn("dataset", F.lit("documents"))
    return docs.unionByName(read(spark, sf_dir, "labels").select("doc_id", "quality").withColumn("dataset", F.lit("labels")), allowMissingColumns=True)


@query("SELECT doc_id, array_to_string(list_filter(['who','what','when','where','why','how','source','unit'], lambda f: list_contains(a, f) OR list_contains(b, f)), ',') AS merged, len(list_intersect(a, b))::INT AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS missing FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['unit','who'] ELSE ['when','source','what'] END AS a, CASE WHEN doc_id % 3 = 0 THEN ['what','who'] ELSE ['why'] END AS b FROM documents)")
def o3_field_sets(spark, sf_dir):
    a = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("unit"), F.lit("who"))).otherwise(F.array(F.lit("when"), F.lit("source"), F.lit("what")))
    b = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("what"), F.lit("who"))).otherwise(F.array(F.lit("why")))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(values.merge_fields(a, b), ",").alias("merged"), F.size(F.array_intersect(a, b)).alias("both"), F.array_join(F.array_except(a, b), ",").alias("missing"))


@query("SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def o6_intersect(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.where("event_type = 'click'").select("user_id").intersect(events.where("event_type = 'purchase'").select("user_id"))
