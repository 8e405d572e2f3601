"""Ranked lexical search by branch and bound over a hierarchical maximum tree of documents.

1. A pass over the texts counts terms and keeps, for each document, its number of terms and the counts of those terms
   that any item asks for. This table is staged: numbers of documents and terms, document frequencies and the search read it.
2. A task lays its documents out in ranges of FAN, these in ranges of FAN, and so on to a single one, and holds for each
   range and term the largest impact that the term has in any document of the range. The sum of an item's weighted maxima
   bounds the score of each document below.
3. For each item, the range of the highest bound is opened next, until no bound reaches the score of the last of the k
   best. A range whose bound equals that score is opened too, as it may hold an equal score of a smaller id.
4. A search over a sixty-fourth of the documents comes first: its k-th score is a bound from below for the whole, so that
   tasks open and return only what can still be among the k best. It changes no result.
5. The k best of the tasks are ranked in two steps, by salt and item and then by item.

The items' terms are the only thing held as a whole. They are taken in batches of about ITEM_TERMS pairs of item and
term, each batch with a pass of its own, so their number is not bounded.

Defined results: null and empty texts have no terms and are never found; items without terms, or whose terms no document
holds, give no rows; rows with one item_id are one item with the terms of all; equal documents are found as many times as
they occur; documents without an id come before others of equal score; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import slices, stage, text_bytes

#: Children of a range.
FAN = 16
#: Postings that a task holds as a tree at a time, and pairs of item and term of a batch. They bound memory only.
SEGMENT, ITEM_TERMS = 4_000_000, 200_000
#: One document in so many is searched first; the rows of an item are ranked in so many parts.
SEED, SALTS = 64, 64
#: Bytes of a text that are cut into terms at a time.
PIECE = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"
FOUND = "item int, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    """Occurrences of each term of a text in UTF-8."""
    found: Counter = Counter()
    text = text.translate(_FOLD)
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + PIECE)
        stop = len(text) if stop < 0 else stop
        found.update(text[start:stop].split())
        start = stop
    return found


def terms(text: Column) -> Column:
    """The same terms as a column, for texts of items."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def _count(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, sizes, asked, counts = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))):
                found = term_counts(text)
                if found:
                    held = sorted((vocabulary[t], found[t]) for t in found.keys() & vocabulary.keys())
                    ids.append(doc)
                    sizes.append(found.total())
                    asked.append([t for t, _ in held])
                    counts.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(asked, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


class Tree:
    """Largest impacts of terms in ranges of documents, by level; level 0 are the documents themselves."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int, terms: int) -> None:
        #: For each level: where the entries of each range begin and the last end, and the term and the maximum of each entry.
        self.levels = [(np.searchsorted(doc, np.arange(docs + 1)), term, impact)]
        ranges = docs
        while ranges > 1:
            ranges = -(-ranges // FAN)
            key = (doc // FAN).astype(np.int64) * terms + term
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            impact = np.maximum.reduceat(impact[order], first) if len(first) else impact
            doc, term = (key[first] // terms).astype(np.int32), (key[first] % terms).astype(np.int32)
            self.levels.append((np.searchsorted(doc, np.arange(ranges + 1)), term, impact))

    def bounds(self, level: int, first: int, last: int, weights: np.ndarray) -> np.ndarray:
        """Summed weighted maxima of the ranges first to last (not included) of a level; at level 0 the scores."""
        begin, term, impact = self.levels[level]
        at = begin[first : last + 1]
        sums = np.concatenate([[0], np.cumsum(weights[term[at[0] : at[-1]]] * impact[at[0] : at[-1]])])[at - at[0]]
        return sums[1:] - sums[:-1]

    def search(self, weights: np.ndarray, ids: list, best: list[tuple], k: int, least: int) -> int:
        """Enters documents into the heap of the k best; opens the range of the highest bound until none can enter. Gives the number opened."""
        size = len(ids)
        top = len(self.levels) - 1
        waiting = [(-int(self.bounds(top, 0, 1, weights)[0]), top, 0)] if size else []
        opened = 0
        while waiting:
            bound, level, place = heappop(waiting)
            if -bound < max(least, best[0][0] if len(best) == k else 1):
                break
            opened += 1
            if level == 0:  # a tree of one document
                first, found = place, np.array([-bound])
            else:
                first, last = place * FAN, min((place + 1) * FAN, len(self.levels[level - 1][0]) - 1)
                found = self.bounds(level - 1, first, last, weights)
            low = max(least, best[0][0] if len(best) == k else 1)
            for child in np.flatnonzero(found >= low).tolist():
                score = int(found[child])
                if level > 1:
                    heappush(waiting, (-score, level - 1, first + child))
                else:
                    doc = ids[first + child]
                    entry = (score, doc is None, 0 if doc is None else -doc)
                    if len(best) < k:
                        heappush(best, entry)
                    else:
                        heappushpop(best, entry)
        return opened


def _search(items: list[list[int]], weights: dict[int, int], n_docs: int, n_terms: int, vocabulary: int, k: int, least: dict[int, int]):
    """The k best documents of a task for each item (lists of term numbers), of those that reach its score in ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in items]
        scale = np.zeros(vocabulary, np.int64)

        def enter(held: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(held)
            ids = rows.column("doc_id").to_pylist()
            n = rows.column("n").to_numpy()
            lists = rows.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(lists.offsets.to_numpy()))
            count = rows.column("counts").combine_chunks().flatten().to_numpy()
            norm = 50 + 50 * n * n_docs // n_terms
            tree = Tree(doc, lists.flatten().to_numpy(), 1_000_000_000 * count // (1000 * count + 20 * norm[doc]), len(ids), vocabulary)
            for i, asked in enumerate(items):
                scale[asked] = [weights.get(t, 0) for t in asked]
                tree.search(scale, ids, best[i], k, least.get(i, 1))
                scale[asked] = 0

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= SEGMENT:
                enter(held)
                held, size = [], 0
        if held:
            enter(held)
        rows = [(i, None if null else -doc, score) for i, b in enumerate(best) for score, null, doc in b]
        columns = list(zip(*rows)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return run


def _batch(docs: DataFrame, asked: list[tuple], k: int) -> DataFrame:
    """Results of the items of one batch: pairs of item id and term."""
    spark = docs.sparkSession
    names = sorted({t for _, t in asked})
    number = {t: i for i, t in enumerate(names)}
    of_item: dict = {}
    for item, term in asked:
        of_item.setdefault(item, []).append(number[term])
    ids, items = list(of_item), [sorted(t) for t in of_item.values()]
    postings = stage(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_count({t.encode(): i for t, i in number.items()}), POSTINGS), "postings")
    whole = postings.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    frequency = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row for each term of the batch
    weights = {r["term"]: math.floor(1000 * math.log((2 * whole["docs"] + 2) / (2 * r["count"] + 1))) for r in frequency}

    def search(rows: DataFrame, least: dict[int, int]) -> DataFrame:
        found = rows.where("size(terms) > 0").mapInArrow(_search(items, weights, whole["docs"], whole["terms"], len(names), k, least), FOUND)
        order = F.desc("score"), F.asc_nulls_first("doc_id")
        salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_salt").orderBy(*order))).where(F.col("rank") <= k)
        return salted.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)

    seed = search(postings.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SEED)) == 0), {}).where(F.col("rank") == k).select("item", "score").collect()  # a row for each item at most
    found = search(postings, {r["item"]: r["score"] for r in seed})
    known = spark.createDataFrame(list(enumerate(ids)), "item int, item_id long")
    return found.join(known, "item").select("item_id", "rank", "doc_id", "score")


def rank(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of highest score for each of the items (item_id, text)."""
    pairs = stage(items.select(F.col("item_id").cast("long"), F.explode(terms(F.col("text"))).alias("term")).distinct(), "item-terms")
    batches = max(1, -(-pairs.count() // ITEM_TERMS))
    found = None
    for b in range(batches):
        asked = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(batches)) == b).select("item_id", "term").collect()
        part = _batch(docs, [tuple(r) for r in asked], k) if asked else None
        found = part if found is None else found if part is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found
