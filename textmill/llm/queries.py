"""The queries of this subpackage and their DuckDB SQL, by name; ``__spark_entry__`` adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import crc_of_id, dealt, table

#: Block and allow rules of the url query: fixed values.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
CAPACITY = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .progressive_jpeg import read, store

    return read(store(table(spark, sf_dir, "documents")), tensors=False)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import similar_classes

    return similar_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "class_id")


OP2_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM cut
), shingles AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sets p ON p.doc_id = x JOIN sets q ON q.doc_id = y WHERE 100 * n >= 75 * (len(p.s) + len(q.s) - n)
), both_ways AS (
  SELECT x, y FROM links UNION SELECT y, x FROM links
), reach(node, other) AS (
  SELECT DISTINCT x, x FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.other
), least AS (
  SELECT node, min(other) AS least FROM reach GROUP BY 1
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(least, doc_id) AS component_id FROM sets LEFT JOIN least ON node = doc_id
"""


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import predict, sample, train

    docs = table(spark, sf_dir, "documents")
    fold = crc_of_id(F.col("doc_id"), 3)
    model = train(*sample(docs, "lang", F.coalesce(fold != 1, F.lit(True))))
    return predict(docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text"), model).drop("text")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import compare_edited

    return compare_edited(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import fit, score

    docs = table(spark, sf_dir, "documents")
    fold = crc_of_id(F.col("doc_id"), 4)
    model = fit(docs, table(spark, sf_dir, "labels"), "quality", fold != 2)
    return score(docs, model).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', doc_id::VARCHAR, coalesce(text, ''))) AS order_key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source
), weighed AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight FROM sources
), tried AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER caps, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER caps, 0)) AS ratio
  FROM weighed WINDOW caps AS (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), settled AS (
  SELECT arg_min(ratio, (3 * source_size / weight, rank)) AS ratio FROM tried WHERE ratio * weight <= 3 * source_size
), plan AS (
  SELECT source, source_size, least(coalesce(settled.ratio * weight, 3 * source_size), 3 * source_size)::DOUBLE AS target,
    CASE WHEN source_size = 0 THEN 0.0 ELSE least(3.0, least(coalesce(settled.ratio * weight, 3 * source_size), 3 * source_size)::DOUBLE / source_size) END AS each_doc
  FROM weighed LEFT JOIN settled ON true
), ranked AS (
  SELECT sized.*, source_size, target, each_doc, row_number() OVER (PARTITION BY sized.source ORDER BY -(8 * length(bin(size)) + (size >> greatest(length(bin(size)) - 3, 0))), order_key) AS r
  FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
), shifted AS (
  SELECT *, ('0x' || left(md5(coalesce(source, '')), 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM ranked
)
SELECT doc_id, size, source_size, target, size * (floor(r * each_doc + u) - floor((r - 1) * each_doc + u))::BIGINT AS taken FROM shifted
"""


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


OP8_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(verdict, rule_host, rule_path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), matched AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) * 1000 + length(rule_path)) AS rule, arg_max(verdict, length(rule_host) * 1000 + length(rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM parts p LEFT JOIN matched m USING (page_id)
"""


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    return score(table(spark, sf_dir, "documents"), F.coalesce(crc_of_id(F.col("doc_id"), 5) != 1, F.lit(True)))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    rows = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH raw AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM raw, LATERAL (SELECT unnest(range(length(h) // 2 - 199)) AS i)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)
), marked AS (
  SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS far, lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL AS first FROM repeated
), numbered AS (
  SELECT doc_id, i, sum((far OR first)::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS span FROM marked
), spans AS (
  SELECT doc_id, span, min(i) AS start, max(i) + 200 AS stop FROM numbered GROUP BY ALL
), gaps AS (
  SELECT doc_id, span, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY span), 0) AS before FROM spans
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY span) AS head, max(stop) AS last FROM gaps JOIN raw USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM raw LEFT JOIN cut USING (doc_id)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import rebuilt, trie, turns

    return trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


OP11_SQL = """
WITH own AS (
  SELECT conv_id, list(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) ORDER BY turn NULLS FIRST) AS keys,
    list(strlen(coalesce(text, ''))::BIGINT ORDER BY turn NULLS FIRST) AS sizes FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM own
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.keys, [])[1:c.h], c.keys[c.h + 1:]) AS keys, list_concat(coalesce(b.sizes, [])[1:c.h], c.sizes[c.h + 1:]) AS sizes
  FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
), members AS (
  SELECT conv_id, sizes, len(keys) AS n, d, coalesce(array_to_string(keys[1:d], ''), '') AS k FROM rebuilt, LATERAL (SELECT unnest(range(len(keys) + 1)) AS d)
), nodes AS (
  SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(sizes[d]), 0) AS size,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM members GROUP BY k
), kids AS (
  SELECT substr(k, 1, 64 * (depth - 1)) AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), sums AS (
  SELECT substr(k, 1, 64 * a) AS k, sum((n_convs - 1) * size)::BIGINT AS saved_tokens, count_if(n_children IS NULL)::BIGINT AS n_leaves
  FROM (SELECT k, n_convs, size, n_children, unnest(range(depth + 1)) AS a FROM nodes LEFT JOIN kids USING (k)) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes p ON n.depth > 0 AND p.k = substr(n.k, 1, 64 * (n.depth - 1))
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), path, public_tokenizers.PATTERN).select("doc_id", "ids")
    digests = F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    return decode(ids, path).select("doc_id", *digests)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import rank

    return rank(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"), 50)


OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sized AS (
  SELECT row_number() OVER () AS row, doc_id, t, len(t)::BIGINT AS n FROM cut WHERE len(t) > 0
), whole AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counted AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs
), scores AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weighed USING (term) JOIN sized USING (row), whole GROUP BY item_id, row
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM scores JOIN sized USING (row) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_progressive_jpeg, op2_ngram_join, op3_language_id, op4_order_minhash, op5_quality_rules, op6_best_fit_packing, op7_source_mixing, op8_url_filter, op9_ppm_score, op10_suffix_dedup, op11_prefix_trie, op12_byte_bpe, op13_lexical_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op10_suffix_dedup": OP10_SQL, "op7_source_mixing": OP7_SQL, "op8_url_filter": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op13_lexical_search": OP13_SQL}
