"""Discovery and crawl logic over tables of fetched pages: candidates, stop rules, best attempts, unique addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

STOPS = ("not_found", "small_page", "repeated_page", "no_links")


def stop_page(pages: DataFrame, source: str, page: str, status: str, size: str, fingerprint: str, links: str, least: int = 200) -> DataFrame:
    """(source, stop page, reason): the first page of each source that ends the walk; null if none does.

    A fingerprint is a repeat if an earlier page of the source had it.
    """
    seen = F.row_number().over(Window.partitionBy(source, fingerprint).orderBy(page)) > 1
    reason = F.when(F.col(status) != 200, STOPS[0]).when(F.col(size) < least, STOPS[1]).when(F.col("_seen"), STOPS[2]).when(F.col(links) == 0, STOPS[3])
    flagged = pages.withColumn("_seen", seen).withColumn("_reason", reason)
    return flagged.groupBy(source).agg(F.min(F.when(F.col("_reason").isNotNull(), F.struct(F.col(page).alias("page"), F.col("_reason").alias("reason")))).alias("s")).select(source, F.col("s.page").alias("stop_page"), F.col("s.reason").alias("reason"))


def distinct_urls(candidates: DataFrame, url: str, order: str) -> DataFrame:
    """Each normalised address with its first row and all its other addresses, in order."""
    grouped = candidates.groupBy("normalized").agg(F.min(F.struct(order, url)).alias("first"), F.array_sort(F.collect_set(url)).alias("all"))
    return grouped.select("normalized", F.col(f"first.{order}").alias("first_id"), F.col(f"first.{url}").alias("first_url"), F.array_except("all", F.array(f"first.{url}")).alias("alternatives"))


def listing_urls(sources: DataFrame, base: str, max_pages: int, path_style: Column) -> DataFrame:
    """One row for each listing page of each source: page/N/ or ?page=N."""
    rows = sources.withColumn("page", F.explode(F.sequence(F.lit(1), F.lit(max_pages))))
    number = F.col("page").cast("string")
    later = F.when(path_style, F.concat(F.col(base), F.lit("page/"), number, F.lit("/"))).otherwise(F.concat(F.col(base), F.lit("?page="), number))
    return rows.withColumn("listing_url", F.when(F.col("page") == 1, F.col(base)).otherwise(later))


def best_attempt(attempts: DataFrame, key: str, score: Column, order: str) -> DataFrame:
    """The attempt with the best score for each key; the earliest of equals."""
    return attempts.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), F.col(order)))).where("_rank = 1").drop("_rank")


def diagnostic_urls(spark: SparkSession, hosts: list[str], templates: list[str], extra: list[str] | None = None) -> DataFrame:
    """Addresses to test: each host, with the extra ones if asked, under both schemes with each template, once each."""
    every = dict.fromkeys(scheme + host + path for host in [*hosts, *(extra or [])] for scheme in ("http://", "https://") for path in templates)
    return spark.createDataFrame([(u,) for u in every], "url string")
