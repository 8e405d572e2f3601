"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Tokenising is the costly part and runs once per document, in Arrow batches. The packing itself needs only how
many pieces there are of each length: at most ``capacity`` numbers whatever the size of the corpus. The driver
reduces and packs this histogram into groups of alike sequences; pieces find their sequence through their rank
within their length, so no task and no driver ever holds the pieces of a length together.

Defined results: a null or empty text is the end token alone; equal rows are packed as many times as they
occur; an empty table gives no rows; other columns of the input are dropped.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
#: Pieces of one length that are ranked together, on average.
RANKED = 50_000
#: Words whose ids a worker keeps. It bounds memory only: other words are tokenised when met.
KEPT_WORDS = 300_000

_SIMPLE = re.compile(r"[!-~ß-öø-ÿ]*")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_BREAK = re.compile(r"[ \n\t\r]+")


class WordIds(dict):
    """Ids of white-space separated chunks, as little-endian 32-bit bytes.

    The vocabulary is a BPE with word ends that drops white space, so the ids of a text are those of its chunks
    in turn. Chunks of plain Latin letters, digits and punctuation go to a faster BPE engine that holds the same
    merges: an appended space plays the word end, and each byte first merges with it. All other chunks go to the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        mark = model["end_of_word_suffix"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

        def raw(token: str) -> bytes:
            body, end = (token[: -len(mark)], b" ") if token.endswith(mark) else (token, b"")
            return bytes(as_byte[c] for c in body) + end

        ranks = {bytes([b]): b for b in range(256)}
        for b in range(256):
            if b != 32:
                ranks[bytes([b, 32])] = len(ranks)
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            ranks.setdefault(raw(left) + raw(right), len(ranks))
        self.ids, self.ends = np.zeros(len(ranks), np.dtype("<u4")), np.zeros(len(ranks), bool)
        for token, i in model["vocab"].items():
            if not token.startswith("<|") and (r := ranks.get(raw(token))) is not None:
                self.ids[r], self.ends[r] = i, token.endswith(mark)
        self.fast = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def learn(self, chunks: list[str]) -> dict[str, bytes]:
        found: dict[str, bytes] = {}
        names, joined, parts = [], [], []
        for c in chunks:
            low = c.lower()
            if _SIMPLE.fullmatch(low) and "<|" not in c:
                pre = _PRETOKEN.findall(low)
                names.append(c)
                joined += pre
                parts.append(len(pre))
            else:
                found[c] = np.array(self.exact.encode(c, add_special_tokens=False).ids, np.dtype("<u4")).tobytes()
        if joined:
            out = self.fast.encode_to_numpy(" ".join(joined) + " ")
            last = np.flatnonzero(self.ends[out]) + 1
            stops = np.concatenate([[0], last])[np.cumsum([0, *parts])] * 4
            data = self.ids[out].tobytes()
            found |= {c: data[a:b] for c, a, b in zip(names, stops[:-1].tolist(), stops[1:].tolist())}
        return found

    def texts(self, texts: list[str]) -> Iterator[bytes]:
        chunks = [_BREAK.split(t) for t in texts]
        new = list({w for ws in chunks for w in ws if w not in self})
        known = self.learn(new)
        if len(self) + len(known) <= KEPT_WORDS:
            self.update(known)
            known = {}
        get, more = self.get, known.get
        for ws in chunks:
            yield b"".join([x for w in ws if (x := get(w)) is not None or (x := more(w)) is not None])


_tokenizers: dict[str, WordIds] = {}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of each document: its ids and the end token, cut where they exceed ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .common import slices

        words = _tokenizers.get(tokenizer_path) or _tokenizers.setdefault(tokenizer_path, WordIds(tokenizer_path))
        end = int(end_id).to_bytes(4, "little")
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.texts([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def reduce_lengths(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets of lengths that an optimal packing may hold, with how often, and the pieces that are in none.

    From the longest length L down, with room = capacity - L, a set with L dominates all others with L if the
    companions of any other set of pieces not yet fixed can be dealt out among its own:
    nothing fits -> L alone; a piece of exactly ``room`` -> that pair; at most one companion fits -> the largest
    that does; at most two fit -> the largest single one if no two weigh more, or the pair (k1, k2) if k1 is the
    largest single one and no second companion is longer than k2. Fixing a set leaves fewer companions to the others,
    so the lengths are gone through until no more is fixed.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for n in lengths:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        groups.append((lengths, times))
        for n, k in need.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]

    def largest(upto: int, used: tuple[int, ...]) -> int:
        return max((n for n in left if n <= upto and left[n] > used.count(n)), default=0)

    def fixed(long: int) -> tuple[int, ...] | None:
        room = capacity - long
        single = largest(room, (long,))
        if not single:
            return (long,)
        if single == room:
            return long, single
        small = sorted(left)[:4]  # one of them may be the piece itself alone
        low = [n for n in small for _ in range(min(3, left[n] - (n == long)))][:3]
        if len(low) < 2 or low[0] + low[1] > room:
            return long, single
        if len(low) == 3 and sum(low) <= room:
            return None
        best, second = 0, 0
        for b in sorted(n for n in left if 2 * n <= room):
            a = largest(room - b, (long, b)) if left[b] > (b == long) else 0
            if a >= b:
                best, second = max(best, a + b), max(second, b)
        if best <= single:
            return long, single
        with_single = largest(room - single, (long, single))
        return (long, single, with_single) if with_single and with_single >= second else None

    before = -1
    while before != len(groups):
        before = len(groups)
        for long in sorted(left, reverse=True):
            while long in left and (found := fixed(long)):
                take(found)
    return groups, left


def reduce_and_pack(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of a sequence, number of such sequences) that hold each piece of the histogram once.

    What the reduction leaves is packed by best fit, longest first. Either step ends one length, or one group, with
    each group it adds, so there are at most a few groups for each length, however many pieces.
    """
    groups, left = reduce_lengths(histogram, capacity)
    rest = dict(sorted(left.items(), reverse=True))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)  # by room left
    for long, count in rest.items():  # longest first
        for room in range(long, capacity):
            while count and bins[room]:
                lengths, n = bins[room].pop()
                each = min(room // long, count)
                used = min(n, count // each)
                if used < n:
                    bins[room].append((lengths, n - used))
                bins[room - each * long].append((lengths + (long,) * each, used))
                count -= used * each
        if count:
            each = capacity // long
            if count >= each:
                bins[capacity - each * long].append(((long,) * each, count // each))
            if count % each:
                bins[capacity - count % each * long].append(((long,) * (count % each), 1))
    return groups + [g for room in sorted(bins) for g in bins[room]]


def slots(groups: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: from that rank on, pieces go to successive sequences."""
    rows, ranks, sequence = [], defaultdict(int), 0
    for lengths, n in groups:
        offset = 0
        for length in lengths:
            rows.append((length, ranks[length], sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of ``docs`` with its sequence and its offset there; see the module for cases."""
    cut = stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    plan = slots(reduce_and_pack(histogram, capacity))
    most = max(histogram.values(), default=0)
    spread = F.create_map(*(F.lit(x).cast("long") for n, c in histogram.items() if c > RANKED for x in (n, -(-c // RANKED)))) if most > RANKED else None
    salts = F.coalesce(spread[F.col("length")], F.lit(1)) if most > RANKED else F.lit(1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    place = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        salted.withColumn("row", F.row_number().over(place))
        .join(before, ["length", "salt"])  # in place: rows are already dealt by these
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("row") - 1).alias("rank"))
    )
    held = docs.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity: a few groups for each length, of ``capacity`` pieces at most

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        starts = plan[:, 0] << 50 | plan[:, 1]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(starts, batch.column("length").to_numpy() << 50 | rank, side="right") - 1
            sequence = plan[at, 2] + rank - plan[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(plan[at, 3])], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(settle, PACKED)
