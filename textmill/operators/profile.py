"""Corpus profiles: counts, coverage, word statistics, breakdowns in one pass, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def counts(df: DataFrame, column: str, unknown: str = "unknown") -> DataFrame:
    value = F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(unknown))
    return df.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def top(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return counts(df, column).orderBy(F.desc("n"), "value").limit(n)


def top_terms(df: DataFrame, terms: str, n: int = 20) -> DataFrame:
    return df.select(F.explode(terms).alias("value")).where("value <> ''").groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def word_stats(df: DataFrame, words: str) -> DataFrame:
    """avg to two digits, median, min, max; zeros if there is no row."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(zero(F.round(F.avg(words), 2)).alias("avg"), zero(F.median(words)).alias("median"), F.coalesce(F.min(words), F.lit(0)).cast("long").alias("min"), F.coalesce(F.max(words), F.lit(0)).cast("long").alias("max"))


def coverage(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Percentage of rows for which each condition holds; zeros if there is no row."""
    share = lambda c: F.coalesce(F.round(100 * F.count_if(c) / F.count("*"), 2), F.lit(0.0))
    wide = df.agg(*(share(c).alias(name) for name, c in fields.items()))
    return wide.select(F.expr("stack({}, {}) as (field, percent)".format(len(fields), ", ".join(f"'{n}', `{n}`" for n in fields))))


def breakdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column and in total, from one pass over the rows by grouping sets."""
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = df.groupingSets(sets, *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
    dimension, value = F.lit("total"), F.lit("")
    for i, c in enumerate(columns):
        gid = ((1 << len(columns)) - 1) & ~(1 << (len(columns) - 1 - i))
        dimension, value = F.when(F.col("gid") == gid, c).otherwise(dimension), F.when(F.col("gid") == gid, F.coalesce(F.col(c).cast("string"), F.lit("unknown"))).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "n")


def distribution(df: DataFrame, label: str) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def request_report(requests: DataFrame, key: str, seconds: str) -> DataFrame:
    """Requests, totals, mean and nearest-rank percentile of the seconds of each key."""
    return requests.groupBy(key).agg(F.count("*").alias("requests"), F.round(F.sum(seconds), 4).alias("total"), F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 4).alias("mean"), F.expr(f"percentile_disc(0.95) within group (order by {seconds})").alias("p95"), F.coalesce(F.max(seconds), F.lit(0.0)).alias("most"))


def group_means(scores: DataFrame, by: str, measures: list[str], digits: int = 4) -> DataFrame:
    """Means by group; nulls are left out of their measure."""
    return scores.groupBy(by).agg(*(F.round(F.avg(m), digits).alias(m) for m in measures))


def select_parallelism(runs: DataFrame, least_gain: float = 1.15, most_memory: float = 7800.0) -> DataFrame:
    """2 if two at a time gain enough without failures within memory, else 1. runs: parallelism, rpm, vram, failures."""
    one, two = (runs.where(F.col("parallelism") == k).agg(F.max("rpm").alias(f"rpm{k}"), F.max("vram").alias(f"vram{k}"), F.sum("failures").alias(f"failures{k}")) for k in (1, 2))
    both = one.crossJoin(two)  # one row each
    good = (F.col("failures2") == 0) & (F.col("vram2") <= most_memory) & (F.col("rpm2") >= least_gain * F.col("rpm1"))
    return both.select(F.when(good, 2).otherwise(1).alias("parallelism"), F.round(F.col("rpm2") / F.col("rpm1"), 4).alias("gain"))
