"""Scalar operators over documents, conversations and events: text, dates, values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, dates, text, values
from .registry import query, read

NORMAL = r"regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(translate(coalesce(text,''), chr(160), ' '), '[ \t\r\f\v]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g')), '^\s+', ''), '\s+$', '')"
KEY = rf"trim(regexp_replace(regexp_replace(lower(strip_accents({NORMAL})), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = rf"regexp_extract_all(lower(strip_accents({NORMAL})), '[\p{{L}}\p{{N}}_]+')"
STOP = "[" + ", ".join(f"'{w}'" for w in text.STRICT_STOPWORDS) + "]"
CONTENT = f"list_distinct(list_filter({TOKENS}, lambda t: length(t) >= 4 AND NOT list_contains({STOP}, t)))"
COLLAPSED = r"trim(regexp_replace(coalesce(text,''), '\s+', ' ', 'g'))"
SENTENCES = rf"list_filter(string_split(regexp_replace({COLLAPSED}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '')"


@query(f"SELECT doc_id, {NORMAL} AS normalized, length({NORMAL})::INT AS n FROM documents")
def t1_normalize_space(spark, sf_dir):
    n = text.normalize_space(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("normalized"), F.length(n).alias("n"))


@query(f"SELECT doc_id, sha256({COLLAPSED}) AS fingerprint, left(translate(coalesce(text,''), chr(10), ' '), 500) AS preview FROM documents")
def t2_collapse_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"), text.preview(F.col("text")).alias("preview"))


@query(f"SELECT doc_id, {KEY} AS title_key, trim(regexp_replace(lower(strip_accents({NORMAL})), '[^a-z0-9]+', ' ', 'g')) AS comparison_key FROM documents")
def t5_title_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.text_key(F.col("text")).alias("title_key"), text.comparison_key(F.col("text")).alias("comparison_key"))


@query(f"SELECT doc_id, len({TOKENS})::INT AS n_tokens, array_to_string({TOKENS}, ' ') AS tokens FROM documents")
def t8_tokens(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT doc_id, len({CONTENT})::INT AS n_tokens, array_to_string(list_sort({CONTENT}), ' ') AS tokens FROM documents")
def t9_content_tokens(spark, sf_dir):
    t = text.content_tokens(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.array_join(F.sort_array(t), " ").alias("tokens"))


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+'))::INT AS word_count, (CASE WHEN len(regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+')) <= 0 THEN 0 ELSE greatest(1, round_even(len(regexp_extract_all(coalesce(text,''), '[\p{L}\p{N}_]+')) / 200.0, 0)) END)::INT AS reading_time FROM documents")
def t10_word_count_reading_time(spark, sf_dir):
    n = text.word_count(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", n.alias("word_count")).withColumn("reading_time", text.reading_time(F.col("word_count")))


@query(f"SELECT doc_id, CASE WHEN {NORMAL} = '' THEN '' ELSE sha256({NORMAL}) END AS content_hash FROM documents")
def t11_text_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.text_hash(F.col("text")).alias("content_hash"))


PARAGRAPHS = f"list_filter(list_transform(string_split(text, chr(10)), lambda text: {NORMAL}), lambda p: p <> '' AND NOT list_contains(['a+','a-','a','menu','compartilhe','ultimas noticias'], lower(strip_accents(p))) AND NOT regexp_matches(lower(strip_accents(p)), 'orgaos do governo|acesso a informacao|redes sociais|todos os direitos reservados'))"


@query(f"WITH p AS (SELECT doc_id, {PARAGRAPHS} AS ps FROM documents) SELECT doc_id, array_to_string(list_filter(ps, lambda x, i: i = 1 OR x <> ps[i - 1]), chr(10) || chr(10)) AS body FROM p")
def t12_clean_body(spark, sf_dir):
    return read(spark, sf_dir, "documents").withColumn("paragraphs", F.split("text", "\n")).select("doc_id", text.clean_body(F.col("paragraphs")).alias("body"))


@query(rf"SELECT doc_id, coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda text: {NORMAL}), lambda p: len(regexp_split_to_array(p, '\s+')) >= 5)[1], '') AS lead FROM documents")
def t13_lead(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.lead(F.split("text", "\n")).alias("lead"))


@query(f"SELECT doc_id, i::INT AS sentence, s[i + 1] AS text FROM (SELECT doc_id, {SENTENCES} AS s FROM documents), LATERAL (SELECT unnest(range(len(s))) AS i)")
def t15_sentences(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sentence", "text"))


@query(f"""SELECT doc_id, CASE WHEN contains(c, '. ') THEN split_part(c, '. ', 1) || '.' WHEN contains(c, '! ') THEN split_part(c, '! ', 1) || '!' WHEN contains(c, '? ') THEN split_part(c, '? ', 1) || '?' ELSE left(c, 240) END AS first_sentence
FROM (SELECT doc_id, {COLLAPSED} AS c FROM documents)""")
def t16_first_sentence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.first_sentence(F.col("text")).alias("first_sentence"))


@query(rf"SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({NORMAL}, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b', '', 'g'), '\b\d{{4}}\b', '', 'g'), '\([^)]*\)', '', 'g'), 'https?://\S+', '', 'g'), '\s+', ' ', 'g')), 600) AS query_text FROM documents")
def t17_query_scrub(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.scrub_query(F.col("text")).alias("query_text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text,''), '(?i)' || w, '[FIELD REMOVED]', 'g'), 'https?://\S+', '[FIELD REMOVED]', 'g'), '\b[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]+\b', '[FIELD REMOVED]', 'g'), '\b\d{1,2}/\d{1,2}/\d{2,4}\b', '[FIELD REMOVED]', 'g') AS redacted
FROM (SELECT doc_id, text, coalesce(list_filter(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: length(x) >= 4)[1], chr(1)) AS w FROM documents)""")
def t19_redact(spark, sf_dir):
    first = F.get(F.filter(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0)), lambda x: F.length(x) >= 4), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", text.redact_fields(F.col("text"), F.array(F.coalesce(first, F.lit("\x01")))).alias("redacted"))


@query(f"SELECT doc_id, len(string_split(key, ' ')) <= 3 AS is_generic, coalesce(list_filter({SENTENCES.replace('text', 'raw')}, lambda s: regexp_matches(s, '(?i)the|der'))[1], '') AS how FROM (SELECT doc_id, text AS raw, {KEY} AS key FROM documents)")
def t23_generic_title_how_sentence(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.generic_title(text.text_key(F.col("text")), ["noticias do campus"]).alias("is_generic"), text.sentence_with(F.col("text"), ["the", "der"]).alias("how"))


@query(rf"SELECT doc_id, {NORMAL.replace('coalesce(text,' + chr(39) * 2 + ')', 'concat_ws(chr(10), source, nullif(text, ' + chr(39) * 2 + '))')} AS text_for_model FROM documents")
def t27_text_for_model(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.model_text(F.col("source"), F.col("text")).alias("text_for_model"))


WRITTEN = """CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y') || ' ' || strftime(ts, '%H:%M') WHEN 2 THEN day(ts)::VARCHAR || ' de ' || ['janeiro','fevereiro','março','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'][month(ts)] || ' de ' || year(ts)::VARCHAR ELSE strftime(ts, '%B ') || day(ts)::VARCHAR || ', ' || year(ts)::VARCHAR END"""


def _written(spark, sf_dir):
    months = F.array(*map(F.lit, ["janeiro", "fevereiro", "março", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro"]))
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(kind == 1, F.date_format("ts", "dd/MM/yyyy HH:mm"))
        .when(kind == 2, F.concat_ws(" de ", F.dayofmonth("ts").cast("string"), F.element_at(months, F.month("ts")), F.year("ts").cast("string")))
        .otherwise(F.concat(F.initcap(F.element_at(F.array(*map(F.lit, dates.ENGLISH)), F.month("ts"))), F.lit(" "), F.dayofmonth("ts").cast("string"), F.lit(", "), F.year("ts").cast("string")))
    )
    return read(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query(f"SELECT event_id, {WRITTEN} AS raw, strftime(ts, '%Y-%m-%d') AS date, CASE WHEN event_id % 4 < 2 THEN strftime(ts, '%H:%M') ELSE '' END AS time, strftime(ts, '%Y') AS year, strftime(ts, '%Y-%m') AS month FROM events")
def d1_parse_date(spark, sf_dir):
    found = _written(spark, sf_dir).withColumn("w", dates.parse_when(F.col("raw")))
    return found.select("event_id", "raw", F.col("w.date").alias("date"), F.col("w.time").alias("time"), dates.year(F.col("w.date")).alias("year"), dates.month(F.col("w.date")).alias("month"))


@query(f"SELECT event_id, CASE WHEN event_id % 4 < 3 THEN regexp_extract(raw, '\\d+/\\d+/\\d+|\\d+-\\d+-\\d+|\\d+ de [^ ]+ de \\d+') ELSE '' END AS first_date, event_id % 4 = 2 AS is_date FROM (SELECT event_id, {WRITTEN} AS raw FROM events)")
def d4_first_date(spark, sf_dir):
    return _written(spark, sf_dir).select("event_id", dates.first_date(F.col("raw")).alias("first_date"), dates.looks_like_date(F.col("raw")).alias("is_date"))


@query("SELECT event_id, TRY_CAST(TRY_CAST(value AS DOUBLE) AS INT) IS NOT NULL AS ok, trunc(value)::INT AS number, lower(event_type) IN ('1','true','yes','sim') AS truth, coalesce(nullif(trim(props), ''), event_type) AS first_filled FROM events")
def m1_coercions(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", F.col("value").try_cast("int").isNotNull().alias("ok"), values.safe_int(F.col("value")).alias("number"), values.truthy(F.col("event_type")).alias("truth"), values.first_nonempty(F.col("props"), F.col("event_type")).alias("first_filled"))


@query(f"""WITH d AS (SELECT doc_id, {CONTENT} AS t FROM documents), b AS (SELECT item_id, {CONTENT} AS t FROM benchmark WHERE item_id % 20 = 0)
SELECT item_id, doc_id, round(CASE WHEN len(list_distinct(list_concat(d.t, b.t))) = 0 THEN 0 ELSE len(list_intersect(d.t, b.t))::DOUBLE / len(list_distinct(list_concat(d.t, b.t))) END, 6) AS jaccard, round(CASE WHEN len(b.t) = 0 THEN 0 ELSE len(list_intersect(d.t, b.t))::DOUBLE / len(b.t) END, 6) AS overlap FROM d, b WHERE list_has_any(d.t, b.t)""")
def m4_jaccard_overlap(spark, sf_dir):
    """A stated set of items (ids divisible by 20) against all documents that share a token with them."""
    tokens = lambda name, key: read(spark, sf_dir, name).select(key, text.content_tokens(F.col("text")).alias("t"))
    docs, items = tokens("documents", "doc_id"), tokens("benchmark", "item_id").where("item_id % 20 = 0")
    meet = docs.select("doc_id", F.explode("t").alias("token")).join(items.select("item_id", F.explode("t").alias("token")), "token").groupBy("item_id", "doc_id").agg(F.count("*").alias("both"))
    sized = meet.join(docs.select("doc_id", F.size("t").alias("nd")), "doc_id").join(items.select("item_id", F.size("t").alias("ni")), "item_id")
    return sized.select("item_id", "doc_id", F.round(F.col("both") / (F.col("nd") + F.col("ni") - F.col("both")), 6).alias("jaccard"), F.round(F.col("both") / F.col("ni"), 6).alias("overlap"))


@query("SELECT doc_id, ('0x' || left(sha256('42:' || doc_id::VARCHAR || ':3'), 16))::UBIGINT::DECIMAL(20,0) AS seed FROM documents")
def m12_stable_seed(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", values.stable_seed(F.lit("42"), F.col("doc_id").cast("string"), F.lit("3")).alias("seed"))


@query("SELECT event_id, json_valid(props) AND json_type(props) = 'OBJECT' AS is_object, json_extract_string(props, '$.k') AS k, CASE WHEN json_type(props) = 'ARRAY' THEN json_array_length(props) ELSE 0 END::INT AS listed FROM events")
def m15_parse_props(spark, sf_dir):
    p = values.json_object(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", p.isNotNull().alias("is_object"), F.try_variant_get(p, "$.k", "string").alias("k"), F.size(values.json_list(F.col("props"))).alias("listed"))


#: Answers made from the events: whole, within a text, no object, other keys, broken off, and with values of wrong kinds.
_ANSWER = """CASE event_id % 6
  WHEN 0 THEN '{"confirmed_information": {"quem": "' || event_type || '", "onde": "u' || CAST(user_id AS STRING) || '"}, "missing_fields": ["quando"], "briefing": " a  ' || event_type || '"}'
  WHEN 1 THEN 'Answer: {"claims": ["' || event_type || ' } x"], "questions": ["Q ' || CAST(user_id AS STRING) || '?"]} end {'
  WHEN 2 THEN '[' || CAST(user_id AS STRING) || ']' WHEN 3 THEN '{"answer": ' || CAST(user_id AS STRING) || '}' WHEN 4 THEN '{"claims": ["' || event_type
  ELSE '{"missing_information": "x", "missing_fields": ["why", "who"], "confirmed_fields": {"source": "' || event_type || '"}}' END"""


@query("""SELECT event_id, CASE event_id % 6 WHEN 2 THEN 'not_an_object' WHEN 3 THEN 'no_known_key' WHEN 4 THEN 'no_json' END AS reason, event_id % 6 = 1 AS recovered,
CASE event_id % 6 WHEN 0 THEN 'who=' || event_type || ',where=u' || user_id WHEN 5 THEN 'source=' || event_type ELSE '' END AS confirmed, CASE event_id % 6 WHEN 0 THEN 'when' WHEN 5 THEN 'who,why' ELSE '' END AS missing,
CASE event_id % 6 WHEN 1 THEN 'Q ' || user_id || '?' ELSE '' END AS questions, CASE event_id % 6 WHEN 1 THEN event_type || ' } x' ELSE '' END AS claims,
CASE event_id % 6 WHEN 0 THEN 'a ' || event_type WHEN 1 THEN '{"claims":["' || event_type || ' } x"],"questions":["Q ' || user_id || '?"]}' WHEN 2 THEN '[' || user_id || ']' WHEN 3 THEN '{"answer": ' || user_id || '}' WHEN 4 THEN '{"claims": ["' || event_type
ELSE '{"confirmed_fields":{"source":"' || event_type || '"},"missing_fields":["why","who"],"missing_information":"x"}' END AS briefing FROM events""")
def m15_answers(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.expr(_ANSWER).alias("answer")).select("event_id", answers.parse_answer(F.col("answer")).alias("a"))
    pairs = F.transform(F.map_entries("a.confirmed"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return rows.select("event_id", "a.reason", "a.recovered", F.array_join(pairs, ",").alias("confirmed"), *(F.array_join(f"a.{c}", ",").alias(c) for c in ("missing", "questions", "claims")), "a.briefing")


@query("SELECT turn, role, CASE lower(role) WHEN 'user' THEN 'who' WHEN 'assistant' THEN 'what' ELSE NULL END AS field, count(*) AS n FROM conversations GROUP BY ALL")
def m17_field_names(spark, sf_dir):
    as_field = F.when(F.col("role") == "user", "Quem ").when(F.col("role") == "assistant", "o que").otherwise(F.col("role"))
    return read(spark, sf_dir, "conversations").select("turn", "role", values.field_name(as_field).alias("field")).groupBy("turn", "role", "field").agg(F.count("*").alias("n"))


@query("SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id::VARCHAR || '}') AS digest FROM events")
def m23_fingerprint(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", values.fingerprint("user_id", "event_type").alias("digest"))
