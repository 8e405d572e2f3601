"""A run of the four configurations that can be stopped and goes on: cases in waves, each committed when it is complete.

The cases that the store does not have are dealt into waves of about ``wave`` by a hash of their ids. A wave asks the
model in rounds: all first, then with a shorter instruction those whose answers could not be read. Answers are written
before they are read, and the records of a wave are written and committed before the next one begins, so a run that is
stopped asks again for the cases of one wave at most, and for none that is committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.answers import parse_answer
from ..operators import configurations
from ..sources.models import NO_MODEL, OK, Calls, ask
from ..sources.scratch import stage
from .checkpoint import CheckpointStore

RECORD = "position long, record string"


class IncompleteRunError(RuntimeError):
    """Some cases have no usable answer of the model; the others are committed."""


def answers(rows: DataFrame, model: Callable[[str], str] | None, calls: Calls, parse_retries: int) -> DataFrame:
    """(case_id, configuration, response, status, status_reason, attempts, readable): the first readable answer, or the last one."""
    done = None
    waiting = None
    for attempt in range(parse_retries + 1):
        asked = configurations.prompts(rows, shorter=attempt > 0)
        if waiting is not None:
            asked = asked.join(waiting, ["case_id", "configuration"], "left_semi")
        found = ask(asked, model, calls).drop("prompt", "calls").withColumns({"attempts": F.lit(attempt + 1 if model else 0), "readable": F.coalesce(parse_answer(F.col("response"))["reason"].isNull() & F.col("response").isNotNull(), F.lit(False))})
        # the only place where the model is asked: staged, so that no later reader asks it again
        found = stage(found, "answers")
        more = ~F.col("readable") & (F.col("status") == OK)
        last = attempt == parse_retries
        taken = found if last else found.where(~more)
        done = taken if done is None else done.unionByName(taken)
        waiting = found.where(more).select("case_id", "configuration")
        if last or waiting.isEmpty():
            break
    return done


def records(written: DataFrame) -> DataFrame:
    """(position, record): a JSON record for each case, its outputs in the order of the configurations."""
    output = F.struct(*(c for c in written.columns if c not in ("case_id", "pitch", "ground_truth", "removed_fields")))
    each = F.array(*(F.any_value(F.when(F.col("configuration") == c, output), True) for c in configurations.CONFIGURATIONS))
    by_case = written.groupBy("case_id").agg(F.any_value("pitch").alias("pitch"), F.any_value("ground_truth").alias("ground_truth"), F.any_value("removed_fields").alias("removed_fields"), each.alias("outputs"))
    case = F.struct("case_id", "pitch", "ground_truth", "removed_fields")
    return by_case.select(F.crc32(F.col("case_id").cast("binary")).alias("position"), F.to_json(F.struct(case.alias("case"), "outputs")).alias("record"))


def run(cases: DataFrame, passages: DataFrame, model: Callable[[str], str] | None, store: CheckpointStore, calls: Calls = Calls(), wave: int = 1000, parse_retries: int = 2, strict: bool = True) -> DataFrame:
    """(case_id, record) of all committed cases; calls the model for those that were not committed yet.

    Without a model, the two configurations that need one say so and the case is complete. A case whose answers fail or
    stay unreadable is not committed: with ``strict`` that is an error after the last wave, and a later call tries again.
    Ids have to be unique and as the store wants them.
    """
    spark: SparkSession = cases.sparkSession
    incoming = f"{store.path}/incoming"
    # the folder has to be there for the stream; what a run wrote and did not commit any more is committed now
    spark.createDataFrame([], RECORD).coalesce(1).write.mode("append").parquet(incoming)
    commit = lambda: store.commit(spark.readStream.schema(RECORD).parquet(incoming))
    commit()
    todo = stage(store.remaining(cases), "todo")
    waves = -(-todo.count() // wave)
    failed = 0
    for number in range(waves):
        part = todo.where(F.pmod(F.xxhash64("case_id"), F.lit(waves)) == number)
        rows = stage(configurations.signals(part, passages.join(part.select("case_id"), "case_id", "left_semi")), "signals")
        given = answers(rows, model, calls, parse_retries)
        bad = stage(given.where(~F.col("readable") & (F.col("status") != NO_MODEL)).select("case_id").distinct(), "unanswered")
        failed += bad.count()
        whole = rows.join(bad, "case_id", "left_anti")
        records(configurations.scored(configurations.outputs(whole, given.drop("readable")))).write.mode("append").parquet(incoming)
        commit()
    if strict and failed:
        raise IncompleteRunError(f"{failed} cases without a readable answer; the others are committed")
    return store.records()
