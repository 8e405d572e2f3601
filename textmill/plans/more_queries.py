"""Further operators: index tables, cues and questions, resume by digest, pagination tests, host summaries, schema unions."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import urls, values
from ..functions.values import FIELDS
from ..operators import cases
from .evaluation_queries import CASE, masked_cases
from .page_queries import HOST
from .registry import query, read
from .retrieval_queries import index_of
from .text_queries import TOKENS


@query(f"WITH t AS (SELECT doc_id AS doc, {TOKENS} AS t FROM documents), p AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(t) AS term FROM t) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS most FROM p GROUP BY 1")
def c17_index_terms(spark, sf_dir):
    """Document and collection frequency of each term of the index."""
    return index_of(spark, sf_dir).terms


@query(f"SELECT doc_id AS doc, len({TOKENS})::INT AS dl FROM documents")
def c17_index_lengths(spark, sf_dir):
    return index_of(spark, sf_dir).lengths


_CUES = {f: "|".join(words) for f, words in cases.CUES.items()}
_KEY_OF_PITCH = r"trim(regexp_replace(regexp_replace(lower(strip_accents(p)), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("WITH " + CASE + ", q AS (SELECT doc_id, array_to_string(list_transform(available, lambda f: MAP {" + ", ".join(f"'{f}': '{v}'" for f, v in cases.LABELS.items()) + f"}}[f] || ': ' || truth[f] || '.'), ' ') || ' {cases.ENDING}' AS p FROM a) SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_KEY_OF_PITCH}, '{_CUES[f]}') THEN '{f}' END" for f in FIELDS) + ") AS cued FROM q")
def c27_cued_fields(spark, sf_dir):
    rows = masked_cases(spark, sf_dir).select("doc_id", cases.pitch(F.col("available")).alias("pitch"))
    return rows.select("doc_id", F.array_join(cases.cued(F.col("pitch")), ",").alias("cued"))


_QUESTIONS = "MAP {" + ", ".join(f"'{f}': '{q}'" for f, q in cases.QUESTIONS.items()) + "}"


@query(f"WITH {CASE} SELECT doc_id, i::INT AS position, removed[i + 1] AS field, {_QUESTIONS}[removed[i + 1]] AS question FROM a, LATERAL (SELECT unnest(range(least(5, len(removed)))) AS i)")
def c28_questions(spark, sf_dir):
    rows = masked_cases(spark, sf_dir).select("doc_id", F.posexplode(cases.questions(F.col("removed_fields"))).alias("position", "q"))
    return rows.select("doc_id", "position", "q.field", "q.question")


@query("WITH s AS (SELECT user_id, event_type, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id::VARCHAR || '}') AS digest FROM events), d AS (SELECT DISTINCT digest FROM s WHERE user_id % 3 = 0) SELECT user_id, event_type, count(*) AS n FROM s WHERE digest NOT IN (SELECT digest FROM d) GROUP BY ALL")
def c32_resume_by_digest(spark, sf_dir):
    """What is left once the saves with known digests are skipped."""
    saves = read(spark, sf_dir, "events").select("user_id", "event_type", values.fingerprint("user_id", "event_type").alias("digest"))
    done = saves.where("user_id % 3 = 0").select("digest").distinct()
    return saves.join(done, "digest", "left_anti").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT page_id % 10 AS source, page_id // 10 AS page, md5(html) AS fp, len(regexp_extract_all(html, '<a ')) AS links FROM pages), f AS (SELECT source, fp, links FROM w WHERE page = 0) SELECT w.source, count_if(w.fp <> f.fp AND w.links > 0)::BIGINT AS different, count_if(w.fp = f.fp)::BIGINT AS same FROM w JOIN f USING (source) WHERE w.page > 0 GROUP BY 1")
def f16_pagination_works(spark, sf_dir):
    """Later pages of each source against its first one."""
    walk = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("source"), F.floor(F.col("page_id") / 10).alias("page"), F.md5("html").alias("fp"), F.regexp_count("html", F.lit("<a ")).alias("links"))
    first = walk.where("page = 0").select("source", F.col("fp").alias("first_fp"))
    return walk.where("page > 0").join(first, "source").groupBy("source").agg(F.count_if((F.col("fp") != F.col("first_fp")) & (F.col("links") > 0)).alias("different"), F.count_if(F.col("fp") == F.col("first_fp")).alias("same"))


@query(f"SELECT regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages, count(DISTINCT lower({HOST})) AS hosts, bool_or(starts_with(url, 'https')) AS secure FROM pages GROUP BY 1")
def a11_host_summary(spark, sf_dir):
    host = urls.host(F.col("url"))
    return read(spark, sf_dir, "pages").groupBy(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct(host).alias("hosts"), F.bool_or(F.startswith("url", F.lit("https"))).alias("secure"))


@query("SELECT source, lang, count(*) AS n, grouping_id(source, lang) AS gid FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def a5_rollup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return docs.groupingSets([[F.col("source"), F.col("lang")], [F.col("source")], []], "source", "lang").agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("SELECT 'documents' AS name, count(*) AS n, count_if(coalesce(text, '') = '')::BIGINT AS empty FROM documents UNION ALL SELECT 'benchmark', count(*), count_if(coalesce(text, '') = '')::BIGINT FROM benchmark UNION ALL SELECT 'conversations', count(*), count_if(coalesce(text, '') = '')::BIGINT FROM conversations")
def o5_concat_summary(spark, sf_dir):
    found = None
    for name in ("documents", "benchmark", "conversations"):
        one = read(spark, sf_dir, name).agg(F.count("*").alias("n"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty")).select(F.lit(name).alias("name"), "n", "empty")
        found = one if found is None else found.unionAll(one)
    return found
