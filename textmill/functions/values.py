"""Numbers, truth values, arrays, maps and JSON as columns. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
FIELDS = ["who", "what", "when", "where", "why", "how", "source", "unit"]
TRUE_WORDS = ["1", "true", "yes", "sim"]
FIELD_ALIASES = {"quem": "who", "que": "what", "o que": "what", "oque": "what", "quando": "when", "onde": "where", "por que": "why", "porque": "why", "como": "how", "fonte": "source", "link": "source", "unidade": "unit", "campus": "unit", "local": "where"}


def safe_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.cast("string").try_cast("double").try_cast("int"), F.lit(default))


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin(TRUE_WORDS), F.lit(False))


def empty_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def first_nonempty(*columns: Column) -> Column:
    return F.coalesce(*map(empty_to_null, columns))


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of b that a holds."""
    n = F.size(F.array_distinct(b))
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / n)


def dcg(relevances: Column) -> Column:
    gains = F.transform(relevances, lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + F.lit(2.0)))
    return F.reduce(gains, F.lit(0.0), lambda a, b: a + b)


def ndcg(relevances: Column, ideal: Column) -> Column:
    best = dcg(ideal)
    return F.when(best == 0, 0.0).otherwise(dcg(relevances) / best)


def stable_seed(*parts: Column) -> Column:
    """The first eight bytes of a hash of the parts, as decimal(20)."""
    return F.conv(F.left(F.sha2(F.concat_ws(":", *parts).cast("binary"), 256), F.lit(16)), 16, 10).cast("decimal(20,0)")


def json_list(x: Column) -> Column:
    return F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))


def json_object(x: Column) -> Column:
    """A JSON object, or the first {...} in the text; null if neither parses."""
    whole = F.when(F.trim(x).startswith("{"), F.try_parse_json(x))
    return F.coalesce(whole, F.try_parse_json(F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))))


def field_name(x: Column) -> Column:
    """A field by its name or an alias; null if it is none."""
    key = F.lower(F.trim(x))
    table = F.create_map(*(F.lit(v) for pair in FIELD_ALIASES.items() for v in pair))
    return F.coalesce(F.when(key.isin(FIELDS), key), F.try_element_at(table, key))


def merge_fields(a: Column, b: Column) -> Column:
    """Union of two lists of fields, in the fixed order."""
    both = F.array_union(a, b)
    return F.filter(F.array(*map(F.lit, FIELDS)), lambda f: F.array_contains(both, f))


def keyword_hits(key: Column, keywords: dict[str, list[str]]) -> Column:
    """label -> its keywords that the text key holds; labels without any are left out."""
    table = F.create_map(*(x for label, words in keywords.items() for x in (F.lit(label), F.array(*map(F.lit, words)))))
    return F.map_filter(F.transform_values(table, lambda _, words: F.filter(words, lambda w: F.contains(key, w))), lambda _, words: F.size(words) > 0)


def split_reasons(x: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ";"), F.trim), lambda r: r != "")


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)


def graded_relevance(same_type: Column, same_unit: Column) -> Column:
    return 2 * F.coalesce(same_type.cast("int"), F.lit(0)) + F.coalesce(same_unit.cast("int"), F.lit(0))


def richness(source_type: Column) -> Column:
    return F.when(source_type == "current", 3).when(source_type == "campus", 2).when(F.coalesce(source_type, F.lit("")) != "", 1).otherwise(0)
