"""Reproducible samples, splits, interleaving and ids. Random order is the order of a hash of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import stage


def shuffled(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(shuffled(seed, key), key).limit(n)


def stratified(df: DataFrame, label: str, n: int, seed: int, key: str) -> DataFrame:
    """n // labels rows of each label, filled up from the rest, all in hash order."""
    labels = df.agg(F.count_distinct(label).alias("labels"))
    order = Window.partitionBy(label).orderBy(shuffled(seed, key), key)
    ranked = df.withColumn("_rank", F.row_number().over(order)).crossJoin(F.broadcast(labels))  # one row
    filled = ranked.withColumn("_late", (F.col("_rank") > F.floor(F.lit(n) / F.col("labels"))).cast("int"))
    return filled.orderBy("_late", shuffled(seed, key), key).limit(n).drop("_rank", "_late", "labels")


def equal_groups(df: DataFrame, label: str, per_group: int, seed: int, key: str) -> DataFrame:
    """Exactly ``per_group`` rows of each label; an error names a label that has fewer."""
    order = Window.partitionBy(label).orderBy(shuffled(seed, key), key)
    ranked = df.withColumn("_rank", F.row_number().over(order)).withColumn("_n", F.count("*").over(Window.partitionBy(label)))
    message = F.concat(F.col(label), F.lit(f" requires {per_group} rows, found "), F.col("_n").cast("string"))
    checked = ranked.withColumn("_rank", F.when(F.col("_n") < per_group, F.raise_error(message).cast("int")).otherwise(F.col("_rank")))
    return checked.where(F.col("_rank") <= per_group).drop("_rank", "_n")


def split(df: DataFrame, label: str, seed: int, key: str, shares: dict[str, float]) -> DataFrame:
    """Adds ``part``: each label is divided by shares in hash order."""
    place = Window.partitionBy(label).orderBy(shuffled(seed, key), key)
    rank = (F.row_number().over(place) - 1) / F.count("*").over(Window.partitionBy(label))
    part, total = F.lit(list(shares)[-1]), sum(shares.values())
    edge = total
    for name in reversed(list(shares)):
        edge -= shares[name]
        part = part if name == list(shares)[-1] else F.when(F.col("_at") < round(edge + shares[name], 9), name).otherwise(part)
    return df.withColumn("_at", rank).withColumn("part", part).drop("_at")


def round_robin(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """First rows of all groups, then second ones, and so on; n in all."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(order))
    return df.withColumn("turn", place).orderBy("turn", group).limit(n)


def balanced(df: DataFrame, label: str, per_label: int, quality: Column, key: str) -> DataFrame:
    order = Window.partitionBy(label).orderBy(quality.desc(), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_label).drop("_rank")


def cyclic(df: DataFrame, group: str, order: str, cycle: list[int], name: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, cycle)), (place % len(cycle) + 1).cast("int")))


def best(df: DataFrame, by: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_rank = 1").drop("_rank")


def numbered(df: DataFrame, prefix: str, order: list[str], name: str) -> DataFrame:
    """Sequential ids over the whole table in a given order.

    Rows are range-partitioned by the order and ranked within partitions; the counts of partitions are summed up
    before, so no task holds all rows. Equal order keys share a partition.
    """
    # staged: ranges and numbers of partitions have to be the same for the counts and for the rows
    ranged = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    held = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = held.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(before), "_part").withColumn(name, F.format_string(prefix + "_%08d", F.col("_before") + place)).drop("_part", "_before")  # one row for each partition
