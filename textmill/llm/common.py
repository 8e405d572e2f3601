"""What the operators share: reading tables, tables in the shared folder, batches of whole texts."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text that one step of an Arrow operator holds as numpy arrays.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """A table of few partitions (a single row group), dealt over all cores; others as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = getattr(spark, "_textmill_dir", None) or "file://" + tempfile.mkdtemp(prefix="textmill-")
        spark._textmill_dir = found
    return found


_recorded = threading.local()


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for paths in getattr(_recorded, "open", [])[-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """At the end, deletes the tables that were staged inside, but for the last one: what is returned may read that one only."""
    _recorded.open = [*getattr(_recorded, "open", []), []]
    try:
        yield
    finally:
        for path in _recorded.open.pop()[:-1]:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread(spark: SparkSession, units: int, per_task: int, least: int | None = None) -> int:
    """Number of partitions for so many units of work, never below the session's shuffle partitions."""
    least = least or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(units) // per_task))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each piece hold about ``size`` bytes, one document at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def text_bytes(column) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def crc_of_id(doc_id, modulus: int):
    """crc32 of the id written as text, by a modulus: how the contracts divide documents into folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
