"""Unit labels: exact, rule and fuzzy matches against a dimension of canonical names, codes and aliases."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from ..functions import text
from ..sources.scratch import stage
from .dedupe import common_subsequence, places, subsequence_of

APPLY, REVIEW = 94.0, 80.0


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_subsequence(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any part of its length of the longer."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n, where = len(short), places(short)
    known = [c in where for c in long]
    held, best = sum(known[:n]), 0
    for i in range(len(long) - n + 1):
        if i:
            held += known[i + n - 1] - known[i - 1]
        if held > best:  # not more than the characters that stand in both
            best = max(best, subsequence_of(where, n, long[i : i + n]))
    return 200.0 * best / (2 * n)


def token_ratio(a: str, b: str, compare=ratio) -> float:
    """The better of sorted tokens, and of common tokens with each rest."""
    left, right = set(a.split()), set(b.split())
    both = " ".join(sorted(left & right))
    one, two = (f"{both} {' '.join(sorted(s - (left & right)))}".strip() for s in (left, right))
    found = [compare(" ".join(sorted(a.split())), " ".join(sorted(b.split())))]
    if both:
        found += [compare(both, one), compare(both, two), compare(one, two)]
    return max(found)


def weighted_ratio(a: str | None, b: str | None) -> float:
    """Plain ratio, tokens at 0.95, and parts at 0.9 or 0.6 where one text is much longer."""
    a, b = a or "", b or ""
    if not a or not b:
        return 0.0
    plain, scale = ratio(a, b), max(len(a), len(b)) / min(len(a), len(b))
    if scale < 1.5:
        return max(plain, token_ratio(a, b) * 0.95)
    part = 0.9 if scale < 8 else 0.6
    return max(plain, partial_ratio(a, b) * part, token_ratio(a, b, partial_ratio) * 0.95 * part)


@F.pandas_udf(DoubleType())
def label_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b)])


def _settled(labels: DataFrame, label: str, aliases: DataFrame, fragments: DataFrame) -> DataFrame:
    """(label, key, exact_code, rule_code) of each different label."""
    # few labels by bytes, but work in UDFs for each: as many tasks as there are cores
    named = labels.select(F.col(label).alias("label")).distinct().repartition(labels.sparkSession.sparkContext.defaultParallelism, "label").withColumn("key", text.comparison_key(F.col("label")))
    exact = named.join(F.broadcast(aliases), F.col("key") == F.col("alias_key"), "left").select("label", "key", F.col("code").alias("exact_code"))  # the dimension is a fixed list
    exact = stage(exact, "exact-labels")
    held = exact.where("exact_code is null and key <> ''").join(F.broadcast(fragments), F.contains("key", "fragment")).groupBy("label").agg(F.min_by("code", "ord").alias("rule_code"))
    return exact.join(held, "label", "left")


def settled_units(labels: DataFrame, label: str, aliases: DataFrame, fragments: DataFrame) -> DataFrame:
    """(label, code, status) of the labels that :func:`match_units` settles by keys and fragments; none is compared with the aliases."""
    rows = _settled(labels, label, aliases, fragments).where("exact_code is not null or rule_code is not null")
    return rows.select("label", F.coalesce("exact_code", "rule_code").alias("code"), F.when(F.col("exact_code").isNotNull(), "exact_match").otherwise("rule_match").alias("status"))


def match_units(labels: DataFrame, label: str, aliases: DataFrame, fragments: DataFrame) -> DataFrame:
    """(label, code, status, score) for each different label.

    aliases (alias_key, code) and fragments (fragment, code, ord) are the dimension. Exact keys come first, then the
    first fragment that the key holds, then the most alike alias: applied from APPLY on, for review from REVIEW on.
    Only different labels that neither rule settles are compared with the aliases, so the UDF sees few rows.
    """
    ruled = stage(_settled(labels, label, aliases, fragments), "settled-labels")
    open_ = ruled.where("exact_code is null and rule_code is null and key <> ''").select("label", "key").repartition(labels.sparkSession.sparkContext.defaultParallelism, "label")
    scored = open_.crossJoin(F.broadcast(aliases)).withColumn("score", F.round(label_score("key", "alias_key"), 2))
    best = scored.groupBy("label").agg(F.max(F.struct("score", F.col("alias_key").alias("alias"), "code")).alias("m")).select("label", "m.score", F.col("m.code").alias("fuzzy_code"))
    rows = ruled.join(best, "label", "left")
    status = F.when(F.col("exact_code").isNotNull(), "exact_match").when(F.col("rule_code").isNotNull(), "rule_match").when(F.col("score") >= APPLY, "fuzzy_match").when(F.col("score") >= REVIEW, "needs_review").otherwise("unknown")
    code = F.coalesce("exact_code", "rule_code", F.when(F.col("score") >= REVIEW, F.col("fuzzy_code")))
    return rows.select("label", code.alias("code"), status.alias("status"), F.when(status.isin("exact_match", "rule_match"), 100.0).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def article_units(articles: DataFrame, key: str, candidates: list[str], context: list[str], aliases: DataFrame, fragments: DataFrame, truncated: str, settled: list[tuple[str, str]], home: str | None = None) -> DataFrame:
    """(key, code, status, score, source_value) of each article: its candidates in their order, the first that applies.

    A label that begins with ``truncated`` names no unit by itself: the first of ``settled`` (pattern, code) that the keys of
    label and context hold decides, else it is for review. If no candidate applies, ``home`` (the code of the source's
    unit) counts, then the first for review; articles without labels are unknown. Each different label is matched once.
    """
    order = F.array(*(text.normalize_space(F.col(c)) for c in candidates))
    rows = articles.select(key, F.array_distinct(F.filter(order, lambda v: v != "")).alias("labels"), F.concat_ws(" ", *context).alias("context"), (F.col(home) if home else F.lit(None).cast("string")).alias("home"))
    each = rows.select(key, "context", F.posexplode("labels").alias("place", "label"))
    matched = each.join(match_units(each, "label", aliases, fragments), "label", "left")
    name = text.comparison_key(F.col("label"))
    cut = ((name == truncated) | F.startswith(name, F.lit(truncated + " "))) & (F.col("status") != "exact_match")
    around = text.comparison_key(F.concat_ws(" ", "label", "context"))
    told = F.coalesce(*(F.when(around.rlike(pattern), F.lit(code)) for pattern, code in settled), F.lit(None).cast("string"))
    matched = matched.withColumns({"cut": cut, "told": told})
    status = F.when(F.col("cut"), F.when(F.col("told").isNotNull(), "rule_match").otherwise("needs_review")).otherwise(F.col("status"))
    code, score = F.when(F.col("cut"), F.col("told")).otherwise(F.col("code")), F.when(F.col("cut"), F.when(F.col("told").isNotNull(), 100.0).otherwise(0.0)).otherwise(F.col("score"))
    matched = matched.select(key, "place", F.struct(status.alias("status"), code.alias("code"), score.alias("score"), F.col("label").alias("source_value")).alias("m"))
    first = lambda *kinds: F.min_by("m", F.when(F.col("m.status").isin(*kinds), F.col("place")))
    by_article = matched.groupBy(key).agg(first("exact_match", "rule_match", "fuzzy_match").alias("applied"), first("needs_review").alias("review"), F.min_by("m", "place").alias("any"))
    found = rows.join(by_article, key, "left")
    kind = F.when(F.col("applied").isNotNull(), F.col("applied.status")).when(F.col("home").isNotNull(), "rule_match").when(F.col("review").isNotNull(), "needs_review").otherwise("unknown")
    points = F.when(F.col("applied").isNotNull(), F.col("applied.score")).when(F.col("home").isNotNull(), 100.0).when(F.col("review").isNotNull(), F.col("review.score")).otherwise(0.0)
    return found.select(key, F.coalesce("applied.code", "home", F.when(kind == "needs_review", F.col("review.code"))).alias("code"), kind.alias("status"), F.round(points, 2).alias("score"), F.coalesce("applied.source_value", "review.source_value", "any.source_value", F.lit("")).alias("source_value"))
