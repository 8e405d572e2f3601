"""Writing corpora: JSON lines, CSV with nested cells as JSON, Parquet, reports as Markdown and LaTeX."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

# Characters that LaTeX reserves.
LATEX = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def flat(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Given columns in order, missing ones empty, nested cells as JSON."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def cell(name: str):
        if name not in kinds:
            return F.lit("").alias(name)
        nested = isinstance(kinds[name], ArrayType | MapType | StructType)
        return (F.to_json(name) if nested else F.col(name)).alias(name)

    return df.select(*map(cell, fields or df.columns))


def csv(df: DataFrame, path: str, fields: list[str] | None = None, mode: str = "overwrite") -> None:
    flat(df, fields).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def both(df: DataFrame, parquet: str, csv_path: str) -> None:
    """Parquet, and CSV from what was written: the plan runs once."""
    df.write.mode("overwrite").parquet(parquet)
    csv(df.sparkSession.read.parquet(parquet), csv_path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def compact(path: str, spark, to: str, files: int) -> None:
    """Rewrites an appended table into few files."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(to)


def name_of(prefix: str, group: str | None, kind: str) -> str:
    return "_".join(p for p in (prefix, group, kind) if p)


def snapshot(pages: DataFrame, path: str) -> None:
    """Raw pages by source, with a safe slug as name."""
    slug = F.left(F.regexp_replace("slug", "[^0-9A-Za-z_-]+", "-"), F.lit(80))
    pages.withColumn("name", slug).write.mode("overwrite").partitionBy("source_id").parquet(path)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """A table of a small result; cells are cleaned, rows beyond ``limit`` are told, not shown."""
    rows = df.limit(limit + 1).collect()
    clean = lambda v: "" if v is None else str(v).replace("|", "/").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    lines += ["| " + " | ".join(clean(v) for v in r) + " |" for r in rows[:limit]]
    return "\n".join(lines + (["", f"(first {limit} rows)"] if len(rows) > limit else []))


def latex_escape(text: str) -> str:
    return "".join(LATEX.get(c, c) for c in text)


def latex(df: DataFrame, limit: int = 200) -> str:
    """A table of a small result; rows beyond ``limit`` are told, not shown."""
    rows = df.limit(limit + 1).collect()
    body = [" & ".join(latex_escape("" if v is None else str(v)) for v in r) + r" \\" for r in rows[:limit]]
    if len(rows) > limit:
        body.append(rf"\multicolumn{{{len(df.columns)}}}{{l}}{{(first {limit} rows)}} \\")
    head = " & ".join(map(latex_escape, df.columns)) + r" \\"
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(df.columns)}}}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])


def initialise(spark: SparkSession, path: str, schema: str, afresh: bool = True) -> None:
    """An empty table to append to; with ``afresh`` in place of what is there, else only where nothing is."""
    spark.createDataFrame([], schema).write.mode("overwrite" if afresh else "ignore").parquet(path)


def atomic_json(spark: SparkSession, path: str, value: object) -> None:
    """A JSON document that readers see whole or not at all: written beside its place, closed, then renamed."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, beside = hadoop.Path(path), hadoop.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = store.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode()))
        out.hsync()
    finally:
        out.close()
    # one step that replaces: readers between see the old document
    kinds = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    place, beside = store.makeQualified(place), store.makeQualified(beside)
    hadoop.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, place, over)


def aliases(spark: SparkSession, tables: dict[str, str]) -> None:
    """Other names for tables of results: a view for each name, of the table at its path."""
    for name, path in tables.items():
        spark.read.parquet(path).createOrReplaceTempView(name)


def checked_run_paths(spark: SparkSession, output: str, pilot: str, checkpoint: str = "checkpoint") -> str:
    """The output folder: it has to be another one than the pilot's, and empty or with a checkpoint to go on from."""
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    store = at(output).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.makeQualified(at(output)).equals(store.makeQualified(at(pilot))):
        raise ValueError("the output folder has to differ from the pilot's")
    if store.exists(at(output)) and len(store.listStatus(at(output))) and not store.exists(at(f"{output}/{checkpoint}")):
        raise ValueError(f"{output} holds something, but no checkpoint")
    return output
