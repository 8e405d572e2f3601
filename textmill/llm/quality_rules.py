"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

Small trees are grown on bootstrap samples and on what earlier trees leave unexplained; each path from a root is a
conjunctive rule. A logistic model with lasso penalty keeps few rules, and the kept ones are compiled into one
Spark column expression over the statistics, so scoring is part of the generated code.

Training takes at most ``SAMPLE`` labelled documents, in hash order (the bound of the sample). The labelled ids are
at most that many and are broadcast to pick the documents.

Defined results: a null text counts as empty and is scored like any other; equal texts get equal scores; an empty
table gives no rows; without labels, or with a single one, every score is its share (0.5 without any). Labels,
languages, sources and ids are never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import slices, text_bytes

SAMPLE = 8000
TREES, DEPTH, LEAST = 40, 3, 25
PENALTIES = (0.01, 0.005, 0.002, 0.001)
STATISTICS = ("chars", "words", "word_length", "upper", "digits", "marks", "symbols", "blanks", "lines", "high_bytes", "packed", "spread", "commonest", "line_repeats", "bare")


def _byte_sets() -> np.ndarray:
    """One row for each share of bytes: upper-case, digits, sentence marks, other symbols, blanks, bytes beyond ASCII."""
    kinds = np.zeros((6, 256))
    kinds[0, 65:91] = kinds[1, 48:58] = kinds[5, 128:] = 1
    kinds[2, list(b".,;:!?'\"-()")] = 1
    kinds[3, [b for b in range(33, 127) if not chr(b).isalnum() and b not in b".,;:!?'\"-()"]] = 1
    kinds[4, list(b" \t\n\r\x0b\x0c")] = 1
    return kinds


KINDS = _byte_sets()
_BARE = re.compile(rb"(?<=\s)[!-/:-@\[-`{-~]+(?=\s)")


def statistics_of(raw: bytes) -> list[float]:
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits, marks, symbols, blanks, high = (KINDS @ counts / n).tolist()
    words, lines = len(raw.split()), raw.split(b"\n")
    share = counts[counts > 0] / n
    inked = counts.copy()
    inked[list(b" \t\n\r\x0b\x0c")] = 0
    return [
        float(n), float(words), n * (1 - blanks) / max(1, words), upper, digits, marks, symbols, blanks, float(len(lines)), high,
        len(zlib.compress(raw, 1)) / n, float(-(share * np.log2(share)).sum()), float(inked.max()) / n, 1 - len(set(lines)) / len(lines), len(_BARE.findall(raw)) / max(1, words),
    ]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with the statistics of each."""
    kept = [c for c in docs.columns if c != text and c not in STATISTICS]
    schema = StructType(docs.select(*kept).schema.fields[:])
    for name in STATISTICS:
        schema = schema.add(name, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = np.array([statistics_of(t) for t in text_bytes(batch.column(text))]).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c) for c in rows.T)], schema.names)

    return docs.select(*kept, F.col(text).cast("string").alias(text)).mapInArrow(run, schema)


#: (statistic, threshold, above): the statistic is above the threshold, or not.
Condition = tuple[int, float, bool]


def _grow(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, path: tuple[Condition, ...], rng: np.random.Generator) -> list[tuple[tuple[Condition, ...], np.ndarray, float]]:
    """Nodes below the root as (path, rows, mean residual); splits lower the squared error most."""
    nodes = [(path, rows, float(residual[rows].mean()))] if path else []
    if not depth or len(rows) < 2 * LEAST:
        return nodes
    best = None
    total, n = residual[rows].sum(), len(rows)
    for k in rng.choice(x.shape[1], size=max(2, x.shape[1] * 2 // 3), replace=False):
        bins = np.searchsorted(cuts[k], x[rows, k], side="left")
        sums = np.cumsum(np.bincount(bins, residual[rows], len(cuts[k]) + 1))[:-1]
        low = np.cumsum(np.bincount(bins, minlength=len(cuts[k]) + 1))[:-1]
        valid = (low >= LEAST) & (n - low >= LEAST)
        if valid.any():
            gain = np.where(valid, sums**2 / np.maximum(low, 1) + (total - sums) ** 2 / np.maximum(n - low, 1), -np.inf)
            at = int(gain.argmax())
            if best is None or gain[at] > best[0]:
                best = gain[at], int(k), float(cuts[k][at])
    if best is None or best[0] <= total**2 / n + 1e-9:
        return nodes
    _, k, cut = best
    above = x[rows, k] > cut
    return nodes + _grow(x, residual, rows[~above], cuts, depth - 1, (*path, (k, cut, False)), rng) + _grow(x, residual, rows[above], cuts, depth - 1, (*path, (k, cut, True)), rng)


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, k] > cut) == above for k, cut, above in rule])


@dataclass
class RuleModel:
    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.intercept + sum((w * holds(r, x) for r, w in self.rules), np.zeros(len(x))))))

    def column(self) -> Column:
        """The whole ensemble as one expression over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            test = F.lit(True)
            for k, cut, above in rule:
                test = test & ((F.col(STATISTICS[k]) > cut) if above else (F.col(STATISTICS[k]) <= cut))
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with lasso penalty by accelerated proximal gradients."""
    n, m = z.shape
    size = np.linalg.norm(np.hstack([z, np.ones((n, 1))]), 2) ** 2 / (4 * n)
    w, b, wv, bv, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(z @ wv + bv))) - y
        new = wv - z.T @ error / n / size
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / size, 0)
        new_b = bv - error.mean() / size
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wv, bv = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def train(x: np.ndarray, y: np.ndarray, seed: int = 11) -> RuleModel:
    if len(y) < 4 * LEAST or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return RuleModel([], float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 60))) for k in range(x.shape[1])]
    fitted = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        residual = y - 1 / (1 + np.exp(-fitted))
        rows = rng.choice(len(y), size=len(y) // 2, replace=False)
        nodes = _grow(x, residual, rows, cuts, DEPTH, (), rng)
        for path, _, _ in nodes:
            found.setdefault(tuple(sorted(path)))
        inner = {p[:k] for p, _, _ in nodes for k in range(1, len(p))}
        for path, _, mean in nodes:
            if path not in inner:
                fitted[holds(path, x)] += 0.6 * mean / 0.25
    rules = list(found)
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(float)
    distinct = sorted({c.tobytes(): i for i, c in reversed(list(enumerate(z.T)))}.values())
    rules, z = [rules[i] for i in distinct], z[:, distinct]
    test = np.arange(len(y)) % 4 == 3
    best = None
    for penalty in PENALTIES:
        w, b = _lasso(z[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[test] @ w + b))), 1e-9, 1 - 1e-9)
        loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
        if best is None or loss < best[0]:
            best = loss, penalty
    w, b = _lasso(z, y, best[1])
    return RuleModel([(r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6], float(b))


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> RuleModel:
    """Trains on labelled documents that ``usable`` (a condition on the labels' doc_id) admits."""
    chosen = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "y").limit(SAMPLE)
    rows = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most SAMPLE rows
    found = np.array(sorted(map(tuple, rows.select("doc_id", "y", *STATISTICS).collect())), float).reshape(-1, len(STATISTICS) + 2)
    return train(found[:, 2:], found[:, 1])


def score(docs: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """Each document's id with score and predicted."""
    return statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
