"""Strict briefings and runs of four configurations: a case for every document whose id is divisible by 20, with passages found by a scan of all others."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import functions as F

from ..functions import text
from ..operators import configurations, labeling, scan, strict
from ..sources.scratch import shared_dir, stage
from ..streaming import evaluation_run
from ..streaming.checkpoint import CheckpointStore
from .corpus_queries import ARTICLES, arts
from .evaluation_queries import TEST_KEYWORDS, WEAK, weak
from .registry import query, read
from .retrieval_queries import OVERLAP
from .text_queries import COLLAPSED, KEY, NORMAL, STOP, TOKENS

CASES, REST = "doc_id % 20 = 0", "doc_id % 20 <> 0"


def strict_cases(spark, sf_dir):
    """The request of a case is its first sentence without dates, numbers and addresses."""
    rows = arts(spark, sf_dir).where(CASES).join(weak(spark, sf_dir), "doc_id")
    why = text.first_sentence(F.col("body"))
    expected = {"who": "environment", "what": "title", "when": "published", "where": "unit", "why": why, "how": F.lit(""), "source": "article_id", "unit": "unit"}
    pairs = (x for f, c in expected.items() for x in (F.lit(f), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    rows = rows.select(F.col("doc_id").alias("case_id"), text.scrub_query(why).alias("pitch"), F.col("label").alias("source_type"), F.col("unit").alias("source_unit"), F.create_map(*pairs).alias("expected"))
    return stage(rows.withColumn("predicted_type", labeling.weak_label(F.col("pitch"), TEST_KEYWORDS)["label"]), "strict-cases")


def strict_passages(spark, sf_dir, cases):
    found = scan.overlap(read(spark, sf_dir, "documents").where(REST), cases, "case_id", "pitch", strict.PASSAGES)
    described = arts(spark, sf_dir).select("doc_id", "title", "unit").join(weak(spark, sf_dir).select("doc_id", F.col("label").alias("type")), "doc_id")
    return found.select(F.col("query").alias("case_id"), "rank", F.col("doc").alias("doc_id")).join(described, "doc_id")


def strict_scores(spark, sf_dir):
    cases = strict_cases(spark, sf_dir)
    return strict.scores(strict.outputs(cases, strict_passages(spark, sf_dir, cases)))


def _signs(question: str) -> list[str]:
    return [f for f, words in strict.SIGNS.items() if any(w in question.lower() for w in words)]


def _sql_list(items) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]::VARCHAR[]"


def _tokens(x: str) -> str:
    return TOKENS.replace("coalesce(text,'')", f"coalesce({x},'')")


def _supported(line: str) -> str:
    content = f"list_distinct(list_filter({_tokens(line)}, lambda t: length(t) >= 4 AND NOT list_contains({STOP}, t)))"
    return f"(len(list_intersect({content}, support)) >= least({strict.ENOUGH}, len({content})))::INT"


_FIRST = f"CASE WHEN contains(c, '. ') THEN split_part(c, '. ', 1) || '.' WHEN contains(c, '! ') THEN split_part(c, '! ', 1) || '!' WHEN contains(c, '? ') THEN split_part(c, '? ', 1) || '?' ELSE left(c, 240) END"
_SCRUB = rf"left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({NORMAL}, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b', '', 'g'), '\b\d{{4}}\b', '', 'g'), '\([^)]*\)', '', 'g'), 'https?://\S+', '', 'g'), '\s+', ' ', 'g')), 600)"
_PRIORITY = "CASE label " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(labeling.PRIORITY)) + " END"
_HITS = " UNION ALL ".join(f"SELECT '{label}' AS label, '{w}' AS word" for label, words in TEST_KEYWORDS.items() for w in words)
_TEMPLATES = ", ".join(f"('{f}', {_sql_list(sorted({f, *_signs(q)}))})" for f, q in strict.QUESTIONS.items())
_EXTRAS = ", ".join(f"('{kind}', {_sql_list(_signs(q) or ['type_specific'])}, {not _signs(q)})" for kind, qs in strict.EXTRA_QUESTIONS.items() for q in qs[: strict.EXTRAS])
_OTHERS = _sql_list(f for f in ("who", "when", "where", "why", "how", "source", "unit"))
_VALUE = "MAP {'who': coalesce(who, ''), 'what': what, 'when': day, 'where': coalesce(unit, ''), 'why': why, 'how': '', 'source': src, 'unit': coalesce(unit, '')}"
STRICT = f"""{WEAK}, ar AS (SELECT doc_id, title, body AS text, environment, unit, published, article_id FROM {ARTICLES}),
p0 AS (SELECT doc_id, title AS what, environment AS who, unit, published AS day, article_id AS src, {_FIRST} AS why FROM (SELECT *, {COLLAPSED} AS c FROM ar WHERE {CASES})),
p1 AS (SELECT *, {_SCRUB} AS pitch FROM (SELECT *, why AS text FROM p0)), pk AS (SELECT doc_id, {KEY} AS key FROM (SELECT doc_id, pitch AS text FROM p1)),
guess AS (SELECT doc_id, coalesce(min_by(label, {_PRIORITY}), 'other') AS predicted FROM pk LEFT JOIN ({_HITS}) k ON contains(pk.key, k.word) GROUP BY doc_id),
asked AS (SELECT doc_id AS item_id, pitch AS text FROM p1), {OVERLAP.replace("FROM documents", f"FROM documents WHERE {REST}").replace("FROM benchmark", "FROM asked")},
pas AS (SELECT query AS doc_id, rank, coalesce(title, '') AS title, label AS type, coalesce(unit, '') AS unit FROM ovr JOIN ar ON ar.doc_id = ovr.doc JOIN weak ON weak.doc_id = ovr.doc WHERE rank <= {strict.PASSAGES}),
pa AS (SELECT doc_id, string_agg(title, ' ' ORDER BY rank) FILTER (rank <= {strict.BEST}) AS titles, string_agg(title, ' ' ORDER BY rank) FILTER (rank <= {strict.NAMED}) AS named, list(type) FILTER (rank <= {strict.BEST}) AS types, list(unit) FILTER (rank <= {strict.BEST}) AS units FROM pas GROUP BY 1),
ex AS (SELECT p1.doc_id, pitch, coalesce(p1.unit, '') AS unit, predicted, label AS type, {_VALUE} AS v, coalesce(titles, '') AS titles, coalesce(named, '') AS named, coalesce(types, []) AS types, coalesce(units, []) AS units, {_tokens('pitch')} AS held FROM p1 JOIN guess USING (doc_id) JOIN weak USING (doc_id) LEFT JOIN pa USING (doc_id)),
mi AS (SELECT *, list_filter({_OTHERS}, lambda f: v[f] <> '' AND len(list_intersect({_tokens('v[f]')}, held)) < greatest(1, least({strict.ENOUGH}, len(list_distinct({_tokens('v[f]')}))))) AS missing,
  list_filter({_sql_list(['what', 'why'])}, lambda f: CASE WHEN f = 'what' THEN pitch ELSE v['why'] END <> '') AS told, len(list_filter({_sql_list(['who', 'what', 'when', 'where', 'why', 'source', 'unit'])}, lambda f: v[f] <> '')) AS n_known FROM ex),
qs AS (SELECT doc_id, missing, told, fields, FALSE AS loose FROM (SELECT doc_id, missing, told, unnest(missing) AS f FROM mi) JOIN (VALUES {_TEMPLATES}) t(f, fields) USING (f) UNION ALL SELECT doc_id, missing, told, fields, loose FROM mi JOIN (VALUES {_EXTRAS}) x(kind, fields, loose) ON kind = predicted),
qr AS (SELECT doc_id, count(*)::INT AS n, sum(CASE WHEN len(list_intersect(fields, told)) > 0 THEN 0.0 WHEN len(list_intersect(fields, missing)) > 0 THEN 1.0 WHEN loose THEN 0.25 ELSE 0.0 END)::DOUBLE AS relevant FROM qs GROUP BY 1),
cf AS (SELECT mi.*, configuration, configuration = '{strict.REPORTER}' AS own, configuration <> '{strict.FIXED}' AS full_, coalesce(n, 0) AS n, coalesce(relevant, 0) AS relevant FROM mi LEFT JOIN qr USING (doc_id), (VALUES ('{strict.FIXED}'), ('{strict.DIRECT}'), ('{strict.REPORTER}')) z(configuration)),
su AS (SELECT *, {_tokens("concat_ws(' ', pitch, v['who'], v['what'], v['when'], v['where'], v['why'], v['source'], v['unit'], CASE WHEN own THEN titles END)")} AS support FROM cf),
pr AS (SELECT *, CASE configuration WHEN '{strict.FIXED}' THEN ({_supported(f"'{strict.FORM_HEAD}'")} + {_supported(f"'{strict.FORM_LINE}' || pitch")}) / 2.0::DOUBLE
  WHEN '{strict.DIRECT}' THEN ({_supported(f"'{strict.DIRECT_HEAD}'")} + {_supported(f"'{strict.DIRECT_LINE}' || pitch")} + {_supported(f"'{strict.DIRECT_NOTE}'")}) / 3.0::DOUBLE
  ELSE ({_supported(f"'{strict.REPORTER_TITLE}'")} + {_supported("'predicted_type ' || predicted")} + {_supported("'confirmed_information what ' || pitch")} + {_supported("'similar_news ' || named")}) / 4.0::DOUBLE END AS precise FROM su),
sc AS (SELECT doc_id AS case_id, configuration,
  round(CASE WHEN n_known = 0 THEN 0.0 ELSE ((pitch <> '' AND v['what'] <> '')::INT + (full_ AND len({_tokens("v['why']")}) > 0)::INT)::DOUBLE / n_known END, 4) AS completeness,
  CASE WHEN own THEN 1.0 ELSE 0.0 END::DOUBLE AS structure,
  round(CASE WHEN len(missing) = 0 OR NOT full_ THEN 0.0 WHEN own THEN 1.0 ELSE len(list_intersect(missing, {_sql_list(strict.ALWAYS_MISSING)}))::DOUBLE / len(missing) END, 4) AS missing_detected,
  round(CASE WHEN own AND n > 0 THEN relevant / n ELSE 0.0 END, 4) AS question_relevance, CASE WHEN own THEN n ELSE 0 END::INT AS n_questions, (own AND list_contains(types, type))::INT AS same_type5,
  CASE WHEN unit <> '' THEN (own AND list_contains(units, unit))::INT END AS same_unit5, round(precise, 4) AS "precision", round(1 - precise, 4) AS hallucination FROM pr)"""


@query(f"""WITH {STRICT} SELECT case_id, configuration, completeness, structure, missing_detected, question_relevance, n_questions, same_type5, same_unit5, "precision", hallucination FROM sc""")
def c23_strict_briefing(spark, sf_dir):
    return strict_scores(spark, sf_dir)


@query(f"""WITH {STRICT} SELECT configuration, count(*) AS cases, {", ".join(f'round(avg("{m}"), {2 if m == "n_questions" else 4}) AS "{m}"' for m in strict.MEASURES)} FROM sc GROUP BY 1""")
def a18_strict_means(spark, sf_dir):
    return strict.aggregate(strict_scores(spark, sf_dir))


def pilot(spark, sf_dir):
    rows = arts(spark, sf_dir).where(CASES)
    how = F.when(F.col("words") > 100, "by mail").otherwise("")
    return configurations.pilot_cases(rows.select(F.format_string("case_%08d", "doc_id").alias("case_id"), "title", F.lit("").alias("lead"), "body", F.col("environment").alias("author"), "unit", "published", F.col("article_id").alias("url"), how.alias("how")))


def _redacted(x: str) -> str:
    for v in ("day", "src", "who", "unit"):
        x = f"CASE WHEN length({v}) >= 4 THEN regexp_replace({x}, '(?i)' || regexp_escape({v}), '[FIELD REMOVED]', 'g') ELSE {x} END"
    return x


_TRUE = "MAP {'what': title, 'who': who, 'when': day, 'where': unit, 'why': why, 'how': how, 'source': src, 'unit': unit}"
_TOLD = "CASE WHEN context <> '' THEN ['what', 'why'] ELSE ['what'] END"
_ALL = "[" + ", ".join(f"'{f}'" for f in configurations.FIELDS) + "]"


@query(f"""WITH a AS (SELECT doc_id, trim(title) AS title, body AS text, CASE WHEN coalesce(environment, '') <> '' THEN environment ELSE coalesce(unit, '') END AS who, coalesce(unit, '') AS unit, published AS day, article_id AS src, CASE WHEN words > 100 THEN 'by mail' ELSE '' END AS how FROM {ARTICLES} WHERE {CASES}),
b AS (SELECT *, {_FIRST} AS why FROM (SELECT *, {COLLAPSED} AS c FROM a)), r AS (SELECT *, {_redacted('title')} AS shown, {_redacted('why')} AS context FROM b)
SELECT printf('case_%08d', doc_id) AS case_id, array_to_string(list_filter([f FOR f IN {_ALL}], lambda f: ({_TRUE})[f] <> '' AND NOT list_contains({_TOLD}, f)), ',') AS removed,
  '{configurations.DEMAND} {configurations.FACT}' || CASE WHEN shown <> '' THEN shown ELSE '{configurations.NO_FACT}' END || '.' || CASE WHEN context <> '' AND context <> shown THEN ' {configurations.CONTEXT}' || context || '.' ELSE '' END || ' {configurations.PENDING}' AS pitch FROM r""")
def c24_pilot_case(spark, sf_dir):
    return pilot(spark, sf_dir).select("case_id", F.array_join("removed_fields", ",").alias("removed"), "pitch")


def scripted_model(prompt: str) -> str:
    """Stands in for a model: repeats the fact of the request; of a third of all prompts the first answer breaks off."""
    fact = prompt.partition(configurations.FACT)[2].partition(".")[0]
    answer = json.dumps({"confirmed_information": {"what": fact}, "missing_information": ["quando", "fonte"], "suggested_questions": [{"question": f"What else is known of {fact[:20]}?"}], "factual_claims": [fact]})
    return answer[:-20] if zlib.crc32(prompt.encode()) % 3 == 0 and configurations.SHORTER not in prompt else answer


@query()
def c29_four_configurations(spark, sf_dir):
    """All cases in one store; each with four outputs, those with a model by :func:`scripted_model`."""
    cases = stage(pilot(spark, sf_dir).withColumn("predicted_type", labeling.weak_label(F.col("pitch"), TEST_KEYWORDS)["label"]), "pilot-cases")
    numbered = cases.select(F.substr("case_id", F.lit(6)).cast("long").alias("id"), "pitch")
    found = scan.overlap(read(spark, sf_dir, "documents").where(REST), numbered, "id", "pitch", configurations.PASSAGES)
    described = arts(spark, sf_dir).select("doc_id", "article_id", "title", text.first_sentence(F.col("body")).alias("lead"), text.preview(F.col("body")).alias("preview"))
    passages = stage(found.join(described, F.col("doc") == F.col("doc_id")).select(F.format_string("case_%08d", "query").alias("case_id"), "rank", "article_id", "title", "lead", "preview"), "passages")
    store = CheckpointStore.create_or_open(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}", {"cases": CASES, "model": "scripted"})
    parsed = F.from_json("record", "outputs array<struct<configuration:string,status:string,attempts:int,confirmed:map<string,string>,missing:array<string>,scores:struct<claims_total:int,claims_supported:int,questions_total:int>>>")
    outputs = evaluation_run.run(cases, passages, scripted_model, store, wave=20_000).select("case_id", F.explode(parsed["outputs"]).alias("o"))
    return outputs.select("case_id", "o.configuration", "o.status", "o.attempts", F.size("o.confirmed").alias("n_confirmed"), F.array_join("o.missing", ",").alias("missing"), "o.scores.*")
