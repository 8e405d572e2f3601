"""A store of finished cases that a stream fills: each case once, with a fingerprint of the run and one of each record.

The store has a manifest with the fingerprint of its run; opened with another one it refuses. Records come as JSON
texts. One whose content a case has already, in whatever order of keys, changes nothing; another content for the same
case is a conflict; one that is no JSON object, has no case or no valid case id is corrupt. Conflicts and corrupt records
are kept as tables of their own and are an error of :meth:`CheckpointStore.commit`.

A batch is joined with the digests of what is saved, so no state is kept beside the store and no case passes through one
task. Batches are written under their number and meet earlier ones only, so one that is repeated after a failure replaces
itself, and a later call goes on where the last one ended.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scratch import stage

CASE_ID = r"^case_\d{4,}$"
SAVED, CONFLICT = "saved", "conflict"


class CheckpointError(RuntimeError):
    pass


class CheckpointMismatchError(CheckpointError):
    pass


class CheckpointCorruptionError(CheckpointError):
    pass


class DuplicateCheckpointError(CheckpointError):
    pass


def checked(records: DataFrame) -> DataFrame:
    """``records`` (position, record) with case_id, the canonical record, and what is wrong with it; the text itself is kept of wrong ones only."""
    kind = lambda path: F.coalesce(F.startswith(F.schema_of_variant(F.try_variant_get("parsed", path, "variant")), F.lit("OBJECT")), F.lit(False))
    # each step is a column of its own, so that a record is parsed once
    parsed = records.select("position", "record", F.try_parse_json("record").alias("parsed"))
    found = parsed.select("position", "record", "parsed", F.try_variant_get("parsed", "$.case.case_id", "string").alias("case_id"))
    # only an object with an object as case has an id, so the kinds of the others alone are looked up
    wrong = F.when(F.col("parsed").isNull(), "no JSON").when(~kind("$"), "no object").when(~kind("$.case"), "no case").otherwise("invalid case_id")
    told = found.select("position", "record", "parsed", "case_id", F.when(~F.coalesce(F.col("case_id").rlike(CASE_ID), F.lit(False)), wrong).alias("reason"))
    valid = F.col("reason").isNull()
    canonical = F.when(valid, F.to_json("parsed"))  # keys of objects are sorted
    return told.select("position", F.when(~valid, F.col("record")).alias("record"), "case_id", canonical.alias("canonical"), "reason")


def _told(rows: DataFrame, status: str) -> DataFrame:
    """Rows of the table of cases; digests are computed here, so that they are not shuffled."""
    return rows.select("case_id", "position", "canonical", F.sha2("canonical", 256).alias("digest"), F.lit(status).alias("status"))


@dataclass
class CheckpointStore:
    spark: SparkSession
    path: str

    @classmethod
    def create_or_open(cls, spark: SparkSession, path: str, fingerprint: dict) -> CheckpointStore:
        """The store at ``path``, made if there is none; an error if it was made with another fingerprint."""
        canonical = json.dumps(fingerprint, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        digest = hashlib.sha256(canonical.encode()).hexdigest()
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
            if manifest["digest"] != digest:
                raise CheckpointMismatchError(f"checkpoint fingerprint {manifest['digest']} does not match {digest}")
        else:
            spark.createDataFrame([(json.dumps({"fingerprint": fingerprint, "digest": digest}),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
        return cls(spark, path)

    def _saved(self) -> DataFrame:
        """(case_id, held, batch): the digests of saved cases."""
        return self.cases().where(F.col("status") == SAVED).select("case_id", F.col("digest").alias("held"), "batch")

    def _batch(self, batch: DataFrame, batch_id: int) -> None:
        """The first record of a case is saved, by position where a batch has several; others with another digest are conflicts."""
        # records are parsed once, and read several times
        rows = stage(checked(batch), "checked")
        valid = rows.where("reason is null").select("case_id", "position", "canonical")
        first = valid.groupBy("case_id").agg(F.min(F.struct(F.col("position").isNull(), "position", "canonical")).alias("first")).select("case_id", "first.position", "first.canonical")
        if batch_id:
            first = first.join(self._saved().where(F.col("batch") < batch_id), "case_id", "left_anti")
        part = f"{self.path}/cases/batch={batch_id}"
        _told(first, SAVED).write.mode("overwrite").parquet(part)
        # what equals the record that is saved goes; rows of a case stand together, so that their digests compress
        held = self._saved().where(F.col("batch") <= batch_id).drop("batch")
        other = valid.join(held, "case_id").where(F.sha2("canonical", 256) != F.col("held")).sortWithinPartitions("case_id")
        _told(other, CONFLICT).write.mode("append").parquet(part)
        rows.where("reason is not null").select("position", "record", "reason").write.mode("overwrite").parquet(f"{self.path}/corrupt/batch={batch_id}")

    def commit(self, records: DataFrame, strict: bool = True) -> None:
        """Takes in what a stream of records (position long, record string) has beyond the last call; with ``strict`` conflicts and corrupt records are errors."""
        run = records.writeStream.option("checkpointLocation", f"{self.path}/read").trigger(availableNow=True).foreachBatch(self._batch).start()
        run.awaitTermination()
        if strict:
            if bad := self.corrupt().orderBy("position").limit(3).collect():
                raise CheckpointCorruptionError("; ".join(f"record {r['position']}: {r['reason']}" for r in bad))
            if bad := self.conflicts().orderBy("position").limit(3).collect():
                raise DuplicateCheckpointError("; ".join(f"{r['case_id']} exists with different content (record {r['position']})" for r in bad))

    def cases(self) -> DataFrame:
        """(case_id, position, canonical, digest, status) of saved records and conflicts."""
        return self.spark.read.schema("case_id string, position long, canonical string, digest string, status string").parquet(f"{self.path}/cases")

    def conflicts(self) -> DataFrame:
        return self.cases().where(F.col("status") == CONFLICT)

    def corrupt(self) -> DataFrame:
        """(position, record, reason)."""
        return self.spark.read.schema("position long, record string, reason string").parquet(f"{self.path}/corrupt")

    def records(self) -> DataFrame:
        """(case_id, record) of the saved cases; fails if a record is not what its digest says."""
        whole = F.when(F.sha2("canonical", 256) == F.col("digest"), F.col("canonical")).otherwise(F.raise_error(F.concat(F.lit("corrupt checkpoint of "), "case_id")))
        return self.cases().where(F.col("status") == SAVED).select("case_id", whole.alias("record"))

    def remaining(self, cases: DataFrame) -> DataFrame:
        """``cases`` without those that are finished, by case_id."""
        return cases.join(self.cases().where(F.col("status") == SAVED).select("case_id"), "case_id", "left_anti")
