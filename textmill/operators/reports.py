"""Reports of crawls, discovery, inspections, evaluations and benchmarks, as rows of (metric, value) or one row a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def tall(wide: DataFrame) -> DataFrame:
    """One row of figures as rows of (metric, value)."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in wide.columns)
    return wide.select(F.expr(f"stack({len(wide.columns)}, {pairs}) as (metric, value)"))


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) != ""


def maximum(x: Column) -> Column:
    return F.coalesce(F.max(x), F.lit(0.0))


def crawl_report(articles: DataFrame) -> DataFrame:
    """Totals by status and of filled fields, and the mean number of words. Columns: status, title, body, published, author, images, links, attachments, words."""
    statuses = {"total_collected": "collected", "total_needs_review": "needs_review", "total_errors": "error"}
    fields = {"total_with_title": "title", "total_with_body": "body", "total_with_publication_date": "published", "total_with_author_or_publisher": "author"}
    flags = {"total_with_images": "images", "total_with_links": "links", "total_with_attachments": "attachments"}
    return tall(
        articles.agg(
            F.count("*").alias("total_attempted"), *(F.count_if(F.col("status") == s).alias(n) for n, s in statuses.items()), *(F.count_if(filled(c)).alias(n) for n, c in fields.items()),
            *(F.count_if(F.col(c)).alias(n) for n, c in flags.items()), F.coalesce(F.round(F.avg("words"), 2), F.lit(0.0)).alias("average_word_count"),
        )
    )


def discovery_report(urls: DataFrame, source: str, page: str, url: str) -> DataFrame:
    """Per source: its pages, addresses seen, different ones, and those merged into others."""
    seen = urls.groupBy(source).agg(F.count_distinct(page).alias("pages"), F.count(url).alias("urls"), F.count_distinct(url).alias("unique_urls"))
    return seen.withColumn("merged", F.col("urls") - F.col("unique_urls"))


def inspection_summary(inspections: DataFrame) -> DataFrame:
    """Columns: status, date, links, documents, words."""
    return tall(
        inspections.agg(
            F.count("*").alias("inspected"), F.count_if(filled("date")).alias("with_normalized_date"), F.count_if(F.col("links") > 0).alias("with_links"), F.count_if(F.col("documents") > 0).alias("with_document_like_links"),
            F.coalesce(F.round(F.avg("words"), 2), F.lit(0.0)).alias("average_word_count"), F.coalesce(F.round(F.median("words"), 2), F.lit(0.0)).alias("median_word_count"),
        )
    )


def dataset_summary(everything: DataFrame, ready: DataFrame) -> DataFrame:
    """Seven metrics: records, model-ready ones, their words, and those with links, attachments and images."""
    left = everything.agg(F.count("*").alias("full_records"))
    flags = [F.count_if(F.col(c)).alias(f"with_{c}") for c in ("links", "attachments", "images")]
    right = ready.agg(F.count("*").alias("canonical_model_ready_records"), F.round(F.avg("words"), 2).alias("avg_word_count"), F.round(F.median("words"), 2).alias("median_word_count"), *flags)
    return tall(left.crossJoin(right))  # one row each


def aggregate(cases: DataFrame, by: str, digits: dict[str, int]) -> DataFrame:
    """Cases and means of each group, each measure to its digits; nulls are left out, a measure without values is null."""
    return cases.groupBy(by).agg(F.count("*").alias("cases"), *(F.round(F.avg(m), n).alias(m) for m, n in digits.items()))


def benchmark(requests: DataFrame, by: str, wall: Column) -> DataFrame:
    """Requests a minute, token sums, mean and nearest-rank p95 of native seconds, and maxima of the telemetry.

    Columns: ok, parsed, prompt_tokens, generated_tokens, native_ns, memory, utilization. wall: seconds of a group, an aggregate.
    """
    ok = lambda c: F.when(F.col("ok"), F.col(c))
    seconds = F.nullif(ok("native_ns"), F.lit(0)) / 1_000_000_000
    grouped = requests.withColumn("_seconds", seconds).groupBy(by).agg(
        F.count_if("ok").alias("successful_requests"), F.count_if(~F.col("ok")).alias("failures"), F.count_if(~F.col("parsed")).alias("parse_failures"), F.round(wall, 4).alias("wall_seconds"),
        F.when(wall > 0, F.round(F.count_if("ok") * 60 / wall, 4)).otherwise(0.0).alias("requests_per_minute"),
        F.coalesce(F.sum(ok("prompt_tokens")), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum(ok("generated_tokens")), F.lit(0)).alias("generated_tokens"),
        F.coalesce(F.round(F.avg("_seconds"), 4), F.lit(0.0)).alias("mean_native_request_seconds"), F.coalesce(F.round(F.expr("percentile_disc(0.95) within group (order by _seconds)"), 4), F.lit(0.0)).alias("p95_native_request_seconds"),
        maximum(F.col("memory")).alias("peak_vram_mib"), maximum(F.col("utilization")).alias("peak_gpu_utilization_percent"),
    )
    return grouped


def ranked(counts: DataFrame, n: str, key: str) -> DataFrame:
    """The place of each row by falling count, then key: for tables of counts, which are short."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc(n), key)))


def best(rows: DataFrame, by: list[str], what: str, *measures: str) -> DataFrame:
    """The ``what`` of the row with the largest measures, in their order, of each group."""
    return rows.groupBy(*by).agg(F.max_by(what, F.struct(*measures)).alias("best"), F.max(F.struct(*measures)).getField(measures[0]).alias(measures[0]))


def example_score(tokens: Column, preferred: list[str], avoided: list[str], whole: Column, short: Column, rich: Column) -> Column:
    """How well a case serves as an example: 5 for each preferred word, -6 for each avoided one, 4, 2 and 1 for the conditions."""
    hits = lambda words: F.size(F.array_intersect(tokens, F.lit(words)))
    return 5 * hits(preferred) - 6 * hits(avoided) + 4 * whole.cast("int") + 2 * short.cast("int") + rich.cast("int")


def examples(rows: DataFrame, by: str, order: str, n: int = 5) -> DataFrame:
    """The first rows of each group; only these leave a task."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("place") <= n)


def ordered_fields(*schemas: list[str]) -> list[str]:
    """Each name once, in the order of first appearance."""
    return list(dict.fromkeys(name for schema in schemas for name in schema))


def error_articles(targets: DataFrame, pages: DataFrame, key: str, message: str = "not fetched") -> DataFrame:
    """An article with status error for each target whose page is missing."""
    left = targets.join(pages.select(key, "html"), key, "left").where("html is null").drop("html")
    return left.withColumns({"status": F.lit("error"), "error_message": F.lit(message), "words": F.lit(0)})


def recommended(listings: DataFrame, source: str) -> DataFrame:
    """Sources to crawl: opened, with news links on some page, and some article that can be extracted. Columns: opened, links, extractable."""
    return listings.groupBy(source).agg((F.bool_or("opened") & (F.max("links") > 0) & F.bool_or("extractable")).alias("recommended"))


def limited(records: DataFrame, environment: str, source: str, order: str, n: int, turns: str) -> DataFrame:
    """The first n records; if all are of the environment ``turns``, first ones of each source in turn."""
    from .sampling import round_robin

    if records.where(~F.col(environment).eqNullSafe(F.lit(turns))).isEmpty():
        return round_robin(records, source, order, n)
    return records.orderBy(order).limit(n)


def field_correct(field: Column, value: Column, expected: Column, overlap: Column) -> Column:
    """when and source hold the expected text; what shares 0.35 of its tokens; others 0.5, or hold the expected text."""
    both = (value != "") & (expected != "")
    exact = F.contains(value, expected)
    other = (overlap >= 0.5) | F.contains(F.lower(value), F.lower(expected))
    return (both & F.when(field.isin("when", "source"), exact).when(field == "what", overlap >= 0.35).otherwise(other)).cast("int")


def field_supported(field: Column, value: Column, expected: Column, value_tokens: Column, expected_tokens: Column) -> Column:
    """Looser: any token in common, or the expected text inside."""
    shared = (F.size(expected_tokens) > 0) & (F.arrays_overlap(value_tokens, expected_tokens) | F.contains(value, expected))
    return (F.coalesce(value, F.lit("")) != "").cast("int") * F.when(field == "what", 1).otherwise(shared.cast("int"))
