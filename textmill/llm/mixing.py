"""Mixing sources to target weights by systematic sampling. Built-in functions only.

Each source gets a target of words; each of its documents is expected ``target / source size`` times. The
documents of a source are laid in a fixed order, expected copies are summed from the first on, one random offset
is added, and a document is emitted once for each integer that its interval crosses. As all documents of a source
expect the same number of copies, the sum up to a document is its rank times that number, so only ranks are
needed: rows are ranked within (source, size class, salt), never within a whole source, and the counts of these
cells are summed up before. Larger documents come first, so that neighbours weigh nearly the same and the words
taken differ from the target by about one of the largest documents.

Defined results: a null text has size 0 and is sampled like the others; a null source is a source of its own,
last in order; equal rows are interchangeable; an empty table gives no rows; a source without words has target 0
and gets no copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
#: No document is taken more often.
MOST = 3
ADDED = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Falls with the size: the number of its binary digits, then the three leading ones."""
    digits = F.length(F.bin(size))
    return -(8 * digits + F.call_function("shiftright", size, F.greatest(digits - 3, F.lit(0)))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares by weight 1, 2, 3, repeating; capped at MOST times the size.

    Resharing what exceeds a cap by weight, until no target is above, ends where all uncapped sources have one
    ratio of target to weight. With sources sorted by cap / weight, the capped ones are the first: the smallest
    number of them after which the ratio exceeds no other cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((MOST * F.col("source_size") / F.col("weight")).asc(), F.col("rank").asc())
    capped = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    weighed = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) - MOST * F.coalesce(F.sum("source_size").over(capped), F.lit(0))
    ratio = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(capped), F.lit(0)))
    tried = weighed.withColumn("ratio", ratio).withColumn("fits", F.col("ratio") * F.col("weight") <= MOST * F.col("source_size"))
    settled = tried.withColumn("settled", F.min(F.when(F.col("fits"), F.struct(F.col("source_size") * MOST / F.col("weight"), "rank", "ratio"))).over(everything)["ratio"])
    target = F.when(F.col("settled").isNull(), MOST * F.col("source_size")).otherwise(F.least(F.col("settled") * F.col("weight"), (MOST * F.col("source_size")).cast("double")))
    return settled.select("source", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken for each row; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ADDED]
    key = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).cast("binary"))
    of = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # never null, so that joins and windows share one exchange
    measured = docs.select(*kept, of.alias("_source"), words(F.col("text")).alias("size"), key.alias("_key")).withColumns({"_class": size_class(F.col("size")), "_salt": F.substring("_key", 1, 2)})
    cells = measured.groupBy("_source", "_class", "_salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    named = F.when(F.col("_source") != "", F.substr("_source", F.lit(2)))
    plan = targets(cells.groupBy("_source").agg(F.sum("words").alias("source_size")).select(named.alias("source"), "source_size"))
    plan = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "source_size", "target")
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_class", "_salt")) - F.col("n")
    cells = cells.withColumn("_before", before).join(plan, "_source").select("_source", "_class", "_salt", "_before", "source_size", "target")
    ranked = measured.withColumn("_row", F.row_number().over(Window.partitionBy("_source", "_class", "_salt").orderBy("_key")))
    joined = ranked.join(cells, ["_source", "_class", "_salt"])  # in place: rows are already dealt by these
    each = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size")))
    offset = F.conv(F.substring(F.md5(F.substr("_source", F.lit(2)).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    rank = F.col("_before") + F.col("_row")
    copies = (F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)).cast("long")
    done = joined.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return done.select(*kept, *ADDED)


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it was taken."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
