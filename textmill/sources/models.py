"""Calls of a model, or of any function of a text, from the tasks of a job, with a bound on how many are under way.

Each task keeps a window of calls in the order of its rows: a new one begins when the oldest has ended, so no more than
``tasks * in_flight`` are under way and a task holds no more than that and one batch of answers. The function is the
caller's and travels to the workers; it may raise :class:`Busy` for a failure that may pass.

A task that is lost is run again and asks again: what asks has to write its answers before they are used twice.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

OK, FAILED, NO_MODEL = "ok", "failed", "requires_model"
#: Answers a task hands on at once.
BATCH = 64
_ADDED = [StructField("response", StringType()), StructField("calls", IntegerType()), StructField("status", StringType()), StructField("status_reason", StringType())]


class Busy(RuntimeError):
    """The model is overloaded or out of reach for now."""


@dataclass(frozen=True)
class Calls:
    """``retries`` more calls after a passing failure, each after twice the pause of the one before, ``longest_pause`` at most; ``cooldown`` seconds of a place in the window after each answer."""

    tasks: int = 8
    in_flight: int = 4
    retries: int = 3
    pause: float = 0.5
    longest_pause: float = 4.0
    cooldown: float = 0.0

    def __post_init__(self) -> None:
        if self.tasks < 1 or self.in_flight < 1 or self.retries < 0:
            raise ValueError("tasks and in_flight have to be positive, retries not negative")

    def one(self, model: Callable[[str], str], prompt: str | None) -> tuple[str | None, int, str, str]:
        """(response, calls, status, reason) of a prompt."""
        for n in range(self.retries + 1):
            try:
                response = model(prompt or "")
                time.sleep(self.cooldown)
                return response, n + 1, OK, ""
            except Busy as e:
                reason = str(e) or "busy"
                if n < self.retries:
                    time.sleep(min(self.pause * 2**n, self.longest_pause))
        return None, self.retries + 1, FAILED, reason


def ask(prompts: DataFrame, model: Callable[[str], str] | None, calls: Calls = Calls(), prompt: str = "prompt") -> DataFrame:
    """``prompts`` with response, calls, status and status_reason.

    Null prompts are asked as empty ones, repeated ones each. Without a model nothing is asked and all rows say so. Errors
    of the function other than :class:`Busy` end the job.
    """
    if model is None:
        none = [F.lit(None).cast("string"), F.lit(0), F.lit(NO_MODEL), F.lit("no model given")]
        return prompts.select("*", *(c.alias(f.name) for c, f in zip(none, _ADDED)))

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in _ADDED]
        with ThreadPoolExecutor(calls.in_flight) as pool:
            window: deque = deque()
            done: list[tuple] = []

            def handed_on() -> pd.DataFrame:
                rows = pd.DataFrame([r for r, _ in done], columns=columns)
                rows[names] = pd.DataFrame([a for _, a in done], columns=names, dtype=object).values
                done.clear()
                return rows

            for part in parts:
                columns = list(part.columns)
                at = columns.index(prompt)
                for row in part.itertuples(index=False, name=None):
                    if len(window) == calls.in_flight:
                        oldest, future = window.popleft()
                        done.append((oldest, future.result()))
                    if len(done) == BATCH:
                        yield handed_on()
                    window.append((row, pool.submit(calls.one, model, row[at])))
            while window:
                oldest, future = window.popleft()
                done.append((oldest, future.result()))
            if done:
                yield handed_on()

    return prompts.repartition(calls.tasks).mapInPandas(task, StructType([*prompts.schema.fields, *_ADDED]))
