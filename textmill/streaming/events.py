"""Incremental work on event files: resumable appends, first-seen filters, windows and sessions with late data."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState

from ..sources.scratch import shared_dir


def _files(spark: SparkSession, folder: str, name: str, files_per_batch: int | None) -> DataFrame:
    """The files of a table as a stream, whether it is one file or a folder of them; all that are there in one batch, if no number is given."""
    path = f"{folder}/{name}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = 1) -> DataFrame:
    """The files of one event table in a folder as a stream, with the schema of what is there; watermarks need its time as a timestamp."""
    return _files(spark, folder, name, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(streamed: DataFrame, mode: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its table.

    Batches are written under their id, so one that is repeated after a failure replaces itself; with the same
    checkpoint and path a later call goes on where this one ended. In complete mode the last batch is the table.
    """
    spark = streamed.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    checkpoint, path = checkpoint or f"{base}/checkpoint", path or f"{base}/table"

    def write(batch: DataFrame, batch_id: int) -> None:
        part = "0" if mode == "complete" else str(batch_id)
        batch.write.mode("overwrite").parquet(f"{path}/batch={part}")

    run = streamed.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    run.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(path).select(streamed.columns)


def tumbling(events: DataFrame, width: str, *by: str, late: str = "1 day") -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("most")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total", "most")


def sliding(events: DataFrame, width: str, step: str, *by: str, late: str = "1 day") -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def sessions(events: DataFrame, gap: str, *by: str, late: str = "1 day") -> DataFrame:
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def first_seen(events: DataFrame, *keys: str) -> DataFrame:
    """Each key once, whenever it comes again."""
    return events.select(*keys).dropDuplicates(list(keys))


def pages(spark: SparkSession, folder: str, files_per_batch: int | None = 1) -> DataFrame:
    """The page files of a folder as a stream."""
    return _files(spark, folder, "pages", files_per_batch)


def known_addresses(rows: DataFrame, order: str, url: str) -> DataFrame:
    """State by normalised address: its first record and how many other addresses it has. The state grows with the addresses, as a crawl's does."""
    grouped = rows.groupBy("normalized").agg(F.min(F.struct(order, url)).alias("first"), F.size(F.collect_set(url)).alias("urls"))
    return grouped.select("normalized", F.col(f"first.{order}").alias("first_id"), F.col(f"first.{url}").alias("first_url"), (F.col("urls") - 1).alias("alternatives"))


def stops(walk: DataFrame, source: str, page: str, fingerprint: str) -> DataFrame:
    """State by source: the fingerprints seen so far; the first page that repeats one is put out, and ends the source's walk."""
    schema = f"{source} long, stop_page long"

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ended = state.get if state.exists else ("", False)
        known = set(filter(None, seen.split(",")))
        for row in pd.concat(list(parts)).sort_values(page).itertuples():
            if not ended and getattr(row, fingerprint) in known:
                ended = True
                yield pd.DataFrame({source: [key[0]], "stop_page": [getattr(row, page)]})
            known.add(getattr(row, fingerprint))
        state.update((",".join(sorted(known)) if not ended else "", ended))

    return walk.groupBy(source).applyInPandasWithState(follow, schema, "seen string, ended boolean", "append", "NoTimeout")
