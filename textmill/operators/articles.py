"""The article view of a plain document table, and the filters on articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text, values

LEAST_WORDS, USABLE_WORDS, DEDUPABLE_WORDS, DEDUPABLE_CHARS = 30, 80, 50, 200


def from_documents(docs: DataFrame) -> DataFrame:
    """Title: the first line; body: the text; environment: the source; unit: the language; date: derived from the id."""
    first_line = F.left(text.collapse(F.substring_index("text", "\n", 1)), F.lit(120))
    return docs.select(
        "doc_id", F.format_string("art_%08d", F.col("doc_id")).alias("article_id"), first_line.alias("title"), F.col("text").alias("body"), F.col("source").alias("environment"), F.col("lang").alias("unit"),
        F.date_format(F.date_add(F.lit("2021-01-01"), (F.col("doc_id") % 1500).cast("int")), "yyyy-MM-dd").alias("published"), text.word_count(F.col("text")).alias("words"),
        F.when(F.col("doc_id") % 17 == 0, "needs_review").when(F.col("doc_id") % 23 == 0, None).otherwise("collected").alias("status"),
    )


def collected(status: Column) -> Column:
    """A missing status counts as collected."""
    return F.coalesce(values.empty_to_null(status), F.lit("collected")) == "collected"


def model_ready(articles: DataFrame) -> DataFrame:
    return articles.where(collected(F.col("status")) & (text.collapse(F.col("body")) != "") & (F.col("words") >= LEAST_WORDS))


def usable(articles: DataFrame) -> DataFrame:
    filled = [values.empty_to_null(F.col(c)).isNotNull() for c in ("title", "body", "unit")]
    return articles.where(collected(F.col("status")) & (F.col("words") >= USABLE_WORDS) & filled[0] & filled[1] & filled[2])


def dedupable(status: Column, words: Column, body: Column) -> Column:
    return collected(status) & (words >= DEDUPABLE_WORDS) & (F.length(text.normalize_space(body)) >= DEDUPABLE_CHARS)


def training_frame(labelled: DataFrame, label: str, least: int = 8, other: str = "other", most_other: float = 0.45) -> DataFrame:
    """Without classes under ``least`` rows, and without ``other`` where it is most of more than two classes."""
    counts = labelled.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    share = counts.agg(F.sum("n").alias("all"), F.count("*").alias("classes"), F.sum(F.when(F.col(label) == other, F.col("n")).otherwise(0)).alias("others"))
    dropped = (F.col(label) == other) & (F.col("others") > most_other * F.col("all")) & (F.col("classes") > 2)
    kept = counts.crossJoin(share).where(~dropped).select(label)  # share is one row
    return labelled.join(F.broadcast(kept), label, "left_semi")  # one row for each class


def canonical_score(status: Column, words: Column, published: Column, unit: Column, images: Column, links: Column, richness: Column) -> list[Column]:
    """What makes a document canonical in its group, most important first; the smallest id decides ties."""
    has = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return [F.coalesce(status == "collected", F.lit(False)), F.coalesce(words, F.lit(0)), has(published), has(unit), F.coalesce(images, F.lit(False)), F.coalesce(links, F.lit(False)), richness]


def view(grouped: DataFrame, canonical: bool) -> DataFrame:
    """The whole corpus, or its canonical documents only."""
    return grouped.where("is_canonical") if canonical else grouped
