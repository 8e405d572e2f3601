"""Reading corpora: JSON lines, CSV, Parquet, JSON documents, telemetry, dimensions, fetched pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Article fields, in order.
ARTICLE_FIELDS = [
    "article_id", "discovered_id", "source_id", "source_name", "source_type", "source_environment", "source_group", "source_url", "discovered_from_url", "discovered_page_number", "original_url", "request_url", "final_url_after_redirect", "canonical_url",
    "http_status", "redirected", "used_ip_access", "ssl_verify_disabled", "slug", "title", "subtitle", "lead", "body_text", "body_html", "publication_date", "publication_time", "date_label_raw", "author_name", "author_url", "publisher_unit", "campus_name",
    "campus_code", "institutional_unit", "campus_name_raw", "institutional_unit_raw", "campus_name_normalized", "institutional_unit_normalized", "unit_normalization_status", "unit_normalization_score", "unit_normalization_source", "unit_normalization_note",
    "categories", "tags", "estimated_reading_time", "comments_count", "access_count", "word_count", "has_images", "has_links", "has_attachments", "content_hash", "title_hash", "title_date_hash", "duplicate_group_id", "duplicate_of", "duplicate_reason",
    "duplicate_confidence", "is_canonical", "collected_at", "updated_at", "status", "error_message",
]
ARTICLE_TYPES = {"categories": "array<string>", "tags": "array<string>"} | dict.fromkeys(["http_status", "word_count", "estimated_reading_time", "discovered_page_number"], "int") | dict.fromkeys(["redirected", "used_ip_access", "ssl_verify_disabled", "has_images", "has_links", "has_attachments", "is_canonical"], "boolean") | dict.fromkeys(["duplicate_confidence", "unit_normalization_score"], "double")
ARTICLE_SCHEMA = ", ".join(f"{name} {ARTICLE_TYPES.get(name, 'string')}" for name in ARTICLE_FIELDS)
RETRIED = [429, 500, 502, 503, 504]


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def jsonl(spark: SparkSession, path: str, schema: str | StructType, missing_ok: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped, a broken one is an error. So is a missing path, or empty if ``missing_ok``."""
    try:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if missing_ok and _missing(error):
            return spark.createDataFrame([], schema)
        raise


def csv(spark: SparkSession, path: str, fields: list[str] | None = None, missing_ok: bool = True) -> DataFrame:
    """CSV with a header, all columns as text; a byte order mark before the header goes."""
    try:
        df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    except AnalysisException as error:
        if missing_ok and _missing(error):
            return spark.createDataFrame([], StructType([StructField(f, StringType()) for f in fields or ["value"]]))
        raise
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})


def records(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """By ending: .csv as text columns cast to the schema, .parquet, anything else as JSON lines."""
    if path.endswith(".csv"):
        rows = csv(spark, path, missing_ok=False)
        wanted = spark.createDataFrame([], schema).schema
        json = lambda f: F.from_json(f.name, f.dataType) if not f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean") else F.col(f.name).try_cast(f.dataType)  # noqa: E731, E713
        return rows.select(*(json(f).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields))
    return spark.read.parquet(path) if path.endswith(".parquet") else jsonl(spark, path, schema)


def json_document(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """One JSON document over many lines; empty if there is none, an error if it is broken."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], schema)
        raise


def number(column: str):
    """The number in a cell with a unit."""
    return F.regexp_replace(column, "[^0-9.-]", "").try_cast("double")


def telemetry(lines: DataFrame) -> DataFrame:
    """Samples from lines ``timestamp, load, memory used, memory total, temperature, power`` with units; shorter lines go."""
    parts = lines.select(F.split("value", r"\s*,\s*").alias("c")).where(F.size("c") >= 6)
    names = ["utilization", "memory_used", "memory_total", "temperature", "power"]
    rows = parts.select(*(F.get("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)))
    return rows.select(*(number(n).alias(n) for n in names)).where("utilization is not null")


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def select_sources(spark: SparkSession, asked: list[str], groups: dict[str, list[str]], known: list[str]) -> DataFrame:
    """(source_id, position) of the asked sources and groups, each once, in the order asked; an unknown name is an error."""
    members: dict[str, None] = {}
    for name in asked:
        if name not in groups and name not in known:
            raise ValueError(f"unknown source or group: {name}")
        for source in groups.get(name, [name]):
            members.setdefault(source)
    return spark.createDataFrame([(s, i) for i, s in enumerate(members)], "source_id string, position int")


@dataclass(frozen=True)
class FetchPolicy:
    """How a fetcher behaves; the fetcher itself is given by the caller."""

    retries: int = 2
    delay: float = 0.5
    timeout: float = 30.0
    backoff: float = 0.75

    def waits(self) -> list[float]:
        return [self.backoff * 2**n for n in range(self.retries)]

    def again(self, status: int | None) -> bool:
        return status is None or status in RETRIED


ATTEMPT = "request_url string, final_url string, status_code int, success boolean, retry_count int, html string, error_message string"


def fetch(targets: DataFrame, get: Callable[[str, float], tuple[int, str, str]], policy: FetchPolicy = FetchPolicy(), url: str = "url", pause: Callable[[float], None] | None = None) -> DataFrame:
    """One attempt record for each address. ``get`` returns (status, final address, body); hosts share a partition, so that delays hold for a host."""
    import time

    wait = pause or time.sleep

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for address in pdf["target"]:
                status, final, body, error, tried = None, address, None, "", 0
                for tried, seconds in enumerate([0.0, *policy.waits()]):
                    wait(seconds or policy.delay)
                    try:
                        status, final, body = get(address, policy.timeout)
                        error = ""
                    except OSError as e:
                        status, error = None, str(e)
                    if not policy.again(status):
                        break
                rows.append((address, final, status, status == 200, tried, body, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ATTEMPT.split(", ")])

    from ..functions.urls import host

    dealt = targets.select(F.col(url).alias("target"), host(F.col(url)).alias("host")).repartition("host").select("target")
    return dealt.mapInPandas(run, ATTEMPT)


def from_pages(targets: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """The same records from a table of pages that were fetched before; addresses it lacks failed."""
    held = pages.select(F.col("url").alias("page_url"), "html")
    joined = targets.select(F.col(url).alias("request_url")).join(held, F.col("request_url") == F.col("page_url"), "left")
    ok = F.col("html").isNotNull()
    return joined.select("request_url", F.col("request_url").alias("final_url"), F.when(ok, 200).alias("status_code"), ok.alias("success"), F.lit(0).alias("retry_count"), "html", F.when(ok, "").otherwise("not in the page table").alias("error_message"))
