"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

Rejected languages go; of similar documents the one with the smallest id stays; repeated strings are cut out;
sources are mixed to their targets, so documents are dropped or repeated; what is left is packed.

Defined results: null texts and texts without a letter go with the rejected languages; rows without an id stay where a
stage keeps one of several; rows that are equal in all columns are interchangeable; further columns of the table are passed
on as they are, whatever their names; n_chars is counted anew where text was cut; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textmill.llm import language_id, mixing, ngram_join, packing, suffix_dedup
from textmill.llm.common import stage, table
from textmill.llm.queries import CAPACITY, tokenizer_path

#: A stage needs the tokenizer, which SQL has not.
ORACLE_SQL = None


#: What the stages work on. Other columns travel in one struct, so that none is taken for a column of an operator.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_others(function: Callable) -> Callable:
    """The stage over the columns it knows; the others are the same after it as before."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return function(spark, docs, sf_dir)
        known = [c for c in docs.columns if c in COLUMNS]
        found = function(spark, docs.select(*known, F.struct(*(docs[f"`{c}`"] for c in others)).alias("_others")), sf_dir)
        return found.select(*(found["_others"][c].alias(c) if c in others else found[c] for c in docs.columns))

    return run


@with_others
def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised with a sufficient score."""
    model = language_id.train(*language_id.sample(docs, "lang", F.lit(True)))
    return language_id.predict(docs, model).where("accepted").select(docs.columns)


@with_others
def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: of those with its smallest id, the first by a hash of the row.

    Documents without words or ids all stay, and so do unlike documents of one id, as each is of its own class.
    """
    found = ngram_join.similar_classes(docs.select(*docs.columns))
    free = F.col("doc_id").isNull() | F.col("class_id").isNull()
    kept = found.where(free | (F.col("doc_id") == F.col("component_id"))).withColumn("_class", F.when(~free, F.col("class_id")))
    many = stage(kept.where("_class is not null").groupBy("_class").count().where("count > 1").select("_class"), "many")
    if many.isEmpty():
        return kept.select(docs.columns)
    ties = kept.join(many, "_class").groupBy("_class").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("row")).select("row.*")
    return kept.join(many, "_class", "left_anti").select(docs.columns).unionByName(ties)


@with_others
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that stand anywhere else too; each document stays, if without text."""
    rows = suffix_dedup.remove_repeats(docs.withColumn("_none", F.col("text").isNull()), whole_characters=True)
    # what is kept is the whole text where nothing goes, so texts need not travel beside it
    whole = F.size("removed") == 0
    text = F.when(~F.col("_none"), F.col("kept").cast("string"))
    return rows.withColumns({"text": text, "n_chars": F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast("long"))}).select(docs.columns)


@with_others
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs), docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), CAPACITY)


STAGES = [("language ID", known_languages), ("n-gram Jaccard join", one_of_similar), ("suffix-array dedup", without_repeats), ("mixing sources", mixed), ("best-fit packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
