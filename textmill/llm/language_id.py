"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a linear layer and a softmax give the
languages. Embeddings and layer are trained by stochastic gradient descent in numpy on at most ``PER_LABEL``
different texts of each label (the bound of the training sample, taken in hash order), whole and as short extracts.
A quarter of the sample is held back for calibration: a temperature for the softmax and the score below which a
prediction is rejected. As averaging and the layer are both linear, each bucket is stored as its score per
language, and a text is read once, whatever the width of the embeddings.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and rejected; equal texts get equal
results; an empty table gives no rows; without training rows everything is ``und``; labels that cannot be told apart
on the calibration texts reject nothing, as the score says nothing there. Ids, sources and given
languages are never inputs of a prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from .common import slices, text_bytes

UNKNOWN = "und"
PER_LABEL, LABELS = 1000, 200
BUCKET_BITS = 15
WIDTH = 16
GRAMS = (2, 3, 4)
EPOCHS = 4
RATE = 0.6
#: Share of rightly labelled calibration texts that may be rejected.
REJECTED = 0.0005

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _fold_table() -> np.ndarray:
    """Lower-cases A-Z and makes one blank of all other ASCII but letters; other bytes stay."""
    fold = np.arange(256, dtype=np.uint8)
    fold[:128] = 32
    lower = np.arange(97, 123)
    fold[lower], fold[lower - 32] = lower, lower
    return fold


FOLD = _fold_table()


def has_letter(raw: bytes) -> bool:
    return bool(_ASCII_LETTER.search(raw)) or not raw.isascii() and any(map(str.isalpha, raw.decode("utf-8", "replace")))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the texts, blank-padded and in a row, and how many each text has."""
    joined = b"  " + b"  ".join(texts) + b"  "
    data = FOLD[np.frombuffer(joined, np.uint8)]
    second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    data[1:][second] += 32
    wide = data.astype(np.uint32)
    lengths = np.array([len(t) + 2 for t in texts])
    total = int(lengths.sum())
    parts = []
    code = wide[: total + 1].copy()
    for n in range(2, max(GRAMS) + 1):
        code = (code << np.uint32(8)) | np.concatenate([wide[n - 1 :], np.full(n, 32, np.uint32)])[: total + 1]
        if n in GRAMS:
            mixed = (code + np.uint32(n)) * np.uint32(2654435761)
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(2246822519)
            parts.append((mixed[1:] >> np.uint32(32 - BUCKET_BITS)).astype(np.int32))
    return np.stack(parts, axis=1)[:total], lengths


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # bucket x label, float32
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros((0, len(self.labels)))
        buckets, lengths = grams(texts)
        each = self.scores[buckets[:, 0]]
        for k in range(1, buckets.shape[1]):
            each += self.scores[buckets[:, k]]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        logits = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / (lengths * buckets.shape[1])[:, None] + self.bias
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _extracts(texts: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """A short extract of each text, so that short texts are known too."""
    found = []
    for t in texts:
        n = int(rng.integers(12, 200))
        a = int(rng.integers(0, max(1, len(t) - n)))
        found.append(t[a : a + n])
    return found


def lowest_accepted(scores: np.ndarray) -> float:
    """The score below which REJECTED of rightly labelled texts are expected to lie.

    With too few of them for that quantile, the next score below all of them: as far from the lowest as that is from its neighbour.
    """
    k, order = int(REJECTED * (len(scores) + 1)), np.sort(scores)
    if k:
        return float(order[k - 1])
    return max(0.0, float(2 * order[0] - order[1])) if len(order) > 1 else 0.0


def train(texts: list[bytes], given: list[str], seed: int = 7) -> Model | None:
    """Fits on all but each fourth row and calibrates on those."""
    labels = sorted(set(given))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    target = np.array([labels.index(g) for g in given])
    held = np.arange(len(texts)) % 4 == 3
    fit = [texts[i] for i in np.flatnonzero(~held)]
    fit_target = np.concatenate([target[~held]] * 2)
    examples = []
    for t in fit + _extracts(fit, rng):
        buckets, counts = np.unique(grams([t])[0], return_counts=True)
        examples.append((buckets, (counts / counts.sum()).astype(np.float32)))
    embedding = rng.normal(0, 0.1, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    steps, done = EPOCHS * len(examples), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            rate = RATE * (1 - done / steps)
            done += 1
            buckets, weight = examples[i]
            mean = weight @ embedding[buckets]
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[fit_target[i]] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            embedding[buckets] -= (rate * 20) * weight[:, None] * back
    model = Model(labels, embedding @ layer, bias, 1.0, 0.0)
    whole = [texts[i] for i in np.flatnonzero(held)]
    if whole:
        check = whole + _extracts(whole, rng)
        truth = np.concatenate([target[held]] * 2)
        logits = np.log(np.maximum(np.concatenate([model.probabilities(check[a : a + 64]) for a in range(0, len(check), 64)]), 1e-30))
        tried = [float(t) for t in np.geomspace(0.1, 10, 41)]
        model.temperature = min(tried, key=lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-30)).mean())
        p = _softmax(logits / model.temperature)
        right = p.argmax(axis=1) == truth
        guess = np.bincount(truth).max() / len(truth)
        if right.mean() > guess + 1 / np.sqrt(len(truth)):  # two standard errors better than the most frequent label
            model.threshold = lowest_accepted(p.max(axis=1)[right])
    return model


def sample(docs: DataFrame, label: str, usable: Column) -> tuple[list[bytes], list[str]]:
    """At most PER_LABEL different texts of each of LABELS labels at most (the most frequent), in the order of a hash of the texts.

    The number of different texts of a label is estimated first. Only texts whose hash lies below a bound, which half as
    many again as are wanted should pass, are collapsed and collected; no task gathers the rows of a label.
    """
    rows = docs.where(usable & F.col("text").isNotNull() & F.col(label).isNotNull()).select(F.col("text"), F.col(label).alias("label"), F.md5(F.col("text").cast("binary")).alias("h"))
    sizes = rows.groupBy("label").agg(F.approx_count_distinct("h", 0.03).alias("n")).orderBy(F.col("n").desc(), "label").limit(LABELS).collect()
    if not sizes:
        return [], []
    bounds = F.create_map(*(F.lit(x) for r in sizes for x in (r["label"], min(1.0, 1.5 * PER_LABEL / max(1, r["n"])))))
    at = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    found: dict[str, list] = {}
    for r in rows.where(at < bounds[F.col("label")]).groupBy("label", "h").agg(F.first("text").alias("text")).collect():  # about 1.5 PER_LABEL rows a label
        found.setdefault(r["label"], []).append((r["h"], r["label"], r["text"]))
    ordered = sorted(x for each in found.values() for x in sorted(each)[:PER_LABEL])
    return [t.encode() for _, _, t in ordered], [g for _, g, _ in ordered]


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels
    added = {"lang_pred": StringType(), "score": DoubleType(), "accepted": BooleanType()}
    kept = [c for c in docs.columns if c not in added]
    schema = StructType(docs.select(*kept).schema.fields[:])
    for name, kind in added.items():
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in slices(batches, text):
            raw = text_bytes(batch.column(text))
            known = np.array([model is not None and has_letter(t) for t in raw], bool)
            names, scores = [UNKNOWN] * len(raw), np.zeros(len(raw))
            at = np.flatnonzero(known)
            if len(at):
                p = model.probabilities([raw[i] for i in at])
                scores[at] = p.max(axis=1)
                for i, k in zip(at.tolist(), p.argmax(axis=1).tolist()):
                    names[i] = model.labels[k]
            accepted = known & (scores >= (model.threshold if model else 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted)], [*kept, *added])

    return docs.mapInArrow(run, schema)
