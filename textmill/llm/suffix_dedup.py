"""Removal of long repeated strings, by a sparse suffix array that is merge-sorted across the cluster.

A byte goes if a string of SPAN bytes that covers it also starts anywhere else. Sorting the suffixes at all bytes
is not needed: of any SPAN bytes in a row, the smallest hash of GRAM bytes picks an anchor, and it picks the same
one wherever that string stands. So each repeat shows among the suffixes at anchors, with up to REACH bytes to
their left, and nothing is missed by leaving out the others.

1. Equal texts are collapsed: of SPAN bytes or more, their copies go whole, and one of them stays as a partner for
   other texts. Texts are dealt into blocks by their hash.
2. A repeat reaches HALF bytes or more from the gram to the right, or to the left. So each anchor has two keys, the
   gram with HALF bytes on either side; a gram that many texts hold in different surroundings has different keys.
   Each side has its own starts of a repeat: RIGHT those fewer than HALF bytes left of the anchor, LEFT the others. So
   the two entries of one anchor never show the same string, which would be a repeat of itself.
   Blocks send hashes of the keys to parts, which answer with those that stand more than once.
3. For these, a block sorts its suffixes (up to SPAN bytes right of the anchor, then the bytes left of it, backwards),
   collapses equal ones and sends each part its run, front-coded: the length shared with the entry before, and the
   rest. All suffixes with one key meet in one part.
4. A part merges the runs by a loser tree that keeps for each entry the length it shares with the last output: a
   longer one wins without a look at the bytes, and equal ones are compared from there on only.
5. In sorted order, suffixes that share their first r bytes are neighbours. For each number j of bytes to the left,
   a string of SPAN bytes repeats if two neighbours share SPAN - j bytes to the right and j to the left.
6. Blocks look up what their anchors' contexts cover, and cut it out.

Groups of alike suffixes are collapsed in each block before they travel, so a part sees one entry of a block for
each different context, however many documents share it. Keys, contexts and bytes left of anchors are held equal if
64-bit hashes of them are.

Defined results: a null text counts as empty; texts under SPAN bytes keep everything; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytehash import Joined, mix
from .common import SLICE_BYTES, spread, slices, text_bytes

SPAN, GRAM = 200, 64
REACH = SPAN - GRAM
HALF = REACH // 2
RIGHT, LEFT = 0, 1
BLOCK_BYTES, PART_BYTES = 16 << 20, 24 << 20


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    pick = np.minimum if least else np.maximum
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Anchors:
    """Anchors of some texts: positions in the joined bytes, hashes of their grams, and bounds of their contexts."""

    def __init__(self, texts: list[bytes]) -> None:
        self.joined = Joined(texts, False)
        size = len(self.joined.data)
        self.at = np.zeros(0, np.int64)
        ends = self.joined.starts + self.joined.lengths
        if size >= SPAN:
            grams = self.joined.windows(GRAM)
            text = np.repeat(np.arange(len(texts)), self.joined.lengths + 1)
            end = ends[text]
            rank = (grams >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            lowest = _sliding(rank, REACH + 1, True)
            n = len(lowest)
            lowest[np.arange(n) + SPAN > end[:n]] = 0  # strings that leave their text
            padded = np.concatenate([np.zeros(REACH, np.uint32), lowest, np.zeros(REACH, np.uint32)])
            best = _sliding(padded, REACH + 1, False)
            self.at = np.flatnonzero((rank == best[: len(rank)]) & (best[: len(rank)] > 0))
            self.at = self.at[self.at + GRAM <= end[self.at]]
            self.text = text[self.at]
        else:
            self.text = np.zeros(0, np.int64)
        self.begin, self.end = self.joined.starts[self.text], ends[self.text]

    def side(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors whose text reaches far enough for a key on this side, the keys, and where their contexts begin and end."""
        first, last = self.at - (HALF if side == LEFT else 0), self.at + GRAM + (HALF if side == RIGHT else 0)
        own = np.flatnonzero((first >= self.begin) & (last <= self.end))
        keys = mix(self.joined.hashes(first[own], last[own]) + np.uint64(side))
        low = np.maximum(self.at[own] - (REACH if side == LEFT else HALF - 1), self.begin[own])
        return own, keys, low, np.minimum(self.at[own] + (SPAN if side == RIGHT else GRAM + HALF), self.end[own])

    def keys(self) -> np.ndarray:
        return np.concatenate([self.side(RIGHT)[1], self.side(LEFT)[1]])

    def contexts(self, side: int, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A hash of each context, of the anchor's place in it and of the side."""
        return mix(self.joined.hashes(low, high) + ((at - low) * 2 + side).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _texts(table: pa.Table) -> tuple[list[bytes], list[int], list[str]]:
    """Different texts of a block by their hash, with how many copies there are of each."""
    found: dict[str, list] = {}
    for h, t, n in zip(table.column("hash").to_pylist(), table.column("text").cast(pa.binary()).to_pylist(), table.column("copies").to_pylist()):
        held = found.setdefault(h, [t, 0])
        held[0] = held[0] if t is None else t
        held[1] += n
    names = sorted(found)
    return [found[h][0] for h in names], [found[h][1] for h in names], names


def _runs_of(texts: list[bytes]) -> Iterator[tuple[int, Anchors]]:
    """Anchors of slices of the texts, with the number of texts before each."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_BYTES:
            yield start, Anchors(texts[start:i])
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, Anchors(texts[start:])


def _different(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys, and whether each comes more than once."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys))) > 1


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)


def _table(rows: list[tuple], names: str, *kinds: pa.DataType) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names.split())


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each different text that a task reads, and one more, without text, for all its further copies."""
    more: dict[str, int] = {}
    for batch in slices(batches):
        rows = []
        for raw in text_bytes(batch.column("text")):
            h = hashlib.md5(raw).hexdigest()
            if h in more:
                more[h] += 1
            else:
                more[h] = 0
                rows.append((h, raw, 1))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([1] * len(rows), pa.int64())], ["hash", "text", "copies"])
    left = [(h, n) for h, n in more.items() if n]
    for a in range(0, len(left), 10_000):
        part = left[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part]), pa.array([None] * len(part), pa.binary()), pa.array([n for _, n in part], pa.int64())], ["hash", "text", "copies"])


def _ask(parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found, many = _different(np.concatenate([a.keys() for _, a in _runs_of(_texts(table)[0])] or [np.zeros(0, np.uint64)]))
        to = _part_of(found, parts)
        order = np.argsort(to, kind="stable")
        found, many, to = found[order], many[order], to[order]
        edges = np.searchsorted(to, np.arange(parts + 1))
        return _table([(p, block, found[a:b].tobytes(), many[a:b].tobytes()) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a], "part block keys many", pa.int32(), pa.int32(), pa.binary(), pa.binary())

    return run


def _tell(table: pa.Table) -> pa.Table:
    """For each block, which of its grams stand more than once anywhere."""
    asked = [(b, np.frombuffer(k, np.uint64), np.frombuffer(m, bool)) for b, k, m in zip(*(table.column(c).to_pylist() for c in ("block", "keys", "many")))]
    everything = np.concatenate([np.concatenate([k, k[m]]) for _, k, m in asked])
    found, many = _different(everything)
    found = found[many]
    rows = []
    for block, keys, _ in asked:
        if len(found):
            at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
            if (hit := found[at] == keys).any():
                rows.append((block, keys[hit].tobytes()))
    return _table(rows, "block keys", pa.int32(), pa.binary())


def front_code(entries: list[bytes]) -> bytes:
    """Sorted entries, each as the length shared with the one before, that of the rest, and the rest."""
    out, before = [], b""
    for e in entries:
        shared = common(before, e, 0)
        out.append(struct.pack("<HH", shared, len(e) - shared))
        out.append(e[shared:])
        before = e
    return b"".join(out)


def front_decode(data: bytes) -> Iterator[tuple[bytes, int]]:
    """The entries, with the length each shares with the one before."""
    at, before = 0, b""
    while at < len(data):
        shared, rest = struct.unpack_from("<HH", data, at)
        before = before[:shared] + data[at + 4 : at + 4 + rest]
        at += 4 + rest
        yield before, shared


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (differ.bit_length() + 7) // 8


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """(run, entry, length shared with the entry before) of all runs in order, by a loser tree on shared lengths."""
    size = 1
    while size < len(runs):
        size *= 2
    done = (None, 0)
    heads: list[tuple[bytes | None, int]] = [next(r, done) for r in runs] + [done] * (size - len(runs))
    heads = [(e, 0) for e, _ in heads]  # nothing is output yet, so nothing is shared with it

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's length becomes what it shares with the winner, which will be output before it."""
        (x, m), (y, n) = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if m != n:
            return (a, b) if m > n else (b, a)
        k = common(x, y, m)
        if x[k:] <= y[k:] if k == len(x) or k == len(y) else x[k] < y[k]:
            heads[b] = (y, k)
            return a, b
        heads[a] = (x, k)
        return b, a

    losers = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while heads[winner][0] is not None:
        yield winner, *heads[winner]
        heads[winner] = next(runs[winner], done)
        node = (winner + size) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def _send(parts: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return _table([], "part block contexts many run", pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        block = texts.column("block")[0].as_py()
        wanted = np.sort(np.concatenate([np.frombuffer(k, np.uint64) for k in told.column("keys").to_pylist()]))
        by_part: dict[int, dict[int, list]] = {}
        for _, a in _runs_of(_texts(texts)[0]):
            data = a.joined.data.tobytes()
            for side in (RIGHT, LEFT):
                own, keys, low, high = a.side(side)
                at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
                chosen = np.flatnonzero(wanted[at] == keys)
                place, low, high = a.at[own[chosen]], low[chosen], high[chosen]
                contexts, to = a.contexts(side, place, low, high).tolist(), _part_of(keys[chosen], parts).tolist()
                for c, p, first, mid, last in zip(contexts, to, low.tolist(), place.tolist(), high.tolist()):
                    held = by_part.setdefault(p, {})
                    if c in held:
                        held[c][1] = True
                    else:
                        held[c] = [data[mid:last].ljust(SPAN, b"\0") + data[first:mid][::-1] + bytes([last - mid]), False]
        rows = []
        for p, held in by_part.items():
            entries = sorted((e, c, many) for c, (e, many) in held.items())
            rows.append((p, block, np.array([c for _, c, _ in entries], np.uint64).tobytes(), np.array([m for _, _, m in entries], bool).tobytes(), front_code([e for e, _, _ in entries])))
        return _table(rows, "part block contexts many run", pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    return run


def covered(entries: list[bytes], shared: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest and most bytes left of the anchor from which a repeated string starts; most is -1 if none does."""
    n = len(entries)
    left_size = np.array([len(e) - SPAN - 1 for e in entries])
    right_size = np.array([e[-1] for e in entries])
    left = np.frombuffer(b"".join(e[SPAN:-1].ljust(REACH, b"\0") for e in entries), np.uint8).reshape(n, REACH)
    least, most = np.full(n, REACH + 1), np.full(n, -1)
    rolled = np.zeros(n, np.uint64)
    for j in range(REACH + 1):
        if j:
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + left[:, j - 1] + np.uint64(1)
        valid = (left_size >= j) & (right_size >= SPAN - j)
        alike = np.cumsum(shared < SPAN - j).astype(np.uint64)
        rows = np.flatnonzero(valid)
        if not len(rows):
            continue
        key = mix(rolled[rows]) + alike[rows] * np.uint64(0xD6E8FEB86659FD93)
        order = np.argsort(key)
        same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        twice = np.zeros(len(rows), bool)
        twice[order] = same | np.concatenate([same[1:], [False]])
        hit = rows[twice | many[rows]]
        least[hit] = np.minimum(least[hit], j)
        most[hit] = j
    return least, most


def _merge(table: pa.Table) -> pa.Table:
    blocks, contexts, many, runs = (table.column(c).to_pylist() for c in ("block", "contexts", "many", "run"))
    order = sorted(range(len(blocks)), key=lambda i: blocks[i])
    contexts, flags = [np.frombuffer(contexts[i], np.uint64) for i in order], [np.frombuffer(many[i], bool) for i in order]
    entries, shared, source = [], [], []
    for run, entry, k in merge_runs([front_decode(runs[i]) for i in order]):
        entries.append(entry)
        shared.append(k)
        source.append(run)
    source, shared = np.array(source), np.array(shared)
    place = np.zeros(len(source), np.int64)  # number of the entry in its run
    for r in range(len(order)):
        place[source == r] = np.arange(len(flags[r]))
    offsets = np.cumsum([0, *map(len, flags)])[:-1]
    least, most = covered(entries, shared, np.concatenate(flags)[offsets[source] + place])
    rows = []
    for r, i in enumerate(order):
        hit = (source == r) & (most >= 0)
        if hit.any():
            rows.append((blocks[i], contexts[r][place[hit]].tobytes(), least[hit].astype(np.uint8).tobytes(), most[hit].astype(np.uint8).tobytes()))
    return _table(rows, "block contexts least most", pa.int32(), pa.binary(), pa.binary(), pa.binary())


def spans(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of intervals as maximal runs."""
    found: list[list[int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist())):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


CUT = "hash string, n_bytes long, kept binary, removed array<struct<start: long, stop: long>>"


def _cut(whole_characters: bool):
    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        raw, copies, names = _texts(texts) if texts.num_rows else ([], [], [])
        parts = [replies.column(c).to_pylist() for c in ("contexts", "least", "most")]
        wanted = np.concatenate([np.frombuffer(x, np.uint64) for x in parts[0]] or [np.zeros(0, np.uint64)])
        least, most = (np.concatenate([np.frombuffer(x, np.uint8) for x in p] or [np.zeros(0, np.uint8)]).astype(np.int64) for p in parts[1:])
        order = np.argsort(wanted)
        wanted, least, most = wanted[order], least[order], most[order]
        found: dict[int, list[tuple[int, int]]] = {}
        if len(wanted):
            for before, a in _runs_of(raw):
                text, first, last = [], [], []
                for side in (RIGHT, LEFT):
                    own, _, low, high = a.side(side)
                    c = a.contexts(side, a.at[own], low, high)
                    at = np.minimum(np.searchsorted(wanted, c), len(wanted) - 1)
                    hit = np.flatnonzero(wanted[at] == c)
                    inside = a.at[own[hit]] - a.begin[own[hit]]
                    text.append(a.text[own[hit]])
                    first.append(inside - most[at[hit]])
                    last.append(inside - least[at[hit]] + SPAN)
                text = np.concatenate(text)
                order = np.argsort(text, kind="stable")
                first, last = np.concatenate(first)[order], np.concatenate(last)[order]
                edges = np.searchsorted(text[order], np.arange(len(a.joined.lengths) + 1))
                for t in np.flatnonzero(np.diff(edges)).tolist():
                    found[before + t] = spans(first[edges[t] : edges[t + 1]], last[edges[t] : edges[t + 1]])
        rows = []
        for i, (t, n, h) in enumerate(zip(raw, copies, names)):
            gone = [(0, len(t))] if n > 1 and len(t) >= SPAN else found.get(i, [])
            edges = [0, *(x for s in gone for x in s), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(edges[0::2], edges[1::2])) if gone else t
            if whole_characters and gone:
                kept = kept.decode("utf-8", "ignore").encode()
            rows.append((h, len(t), kept, [{"start": a, "stop": b} for a, b in gone]))
        return _table(rows, "hash n_bytes kept removed", pa.string(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))

    return run


def remove_repeats(docs: DataFrame, whole_characters: bool = False) -> DataFrame:
    """``docs`` with n_bytes, kept (the bytes that stay) and removed (the spans that go).

    A span may begin or end inside a character; with ``whole_characters`` what is left of such characters is not kept.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks, parts = spread(spark, size, BLOCK_BYTES), spread(spark, size, PART_BYTES)
    different = docs.select(text.alias("text")).mapInArrow(_collapse, "hash string, text binary, copies long")
    dealt = different.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(parts), "part int, block int, keys binary, many binary")
    told = asked.groupBy("part").applyInArrow(_tell, "block int, keys binary")
    sent = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_send(parts), "part int, block int, contexts binary, many binary, run binary")
    merged = sent.groupBy("part").applyInArrow(_merge, "block int, contexts binary, least binary, most binary")
    cut = dealt.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(_cut(whole_characters), CUT)
    kept = [c for c in docs.columns if c not in ("n_bytes", "kept", "removed")]
    return docs.select(*kept, F.md5(text.cast("binary")).alias("_row_hash")).join(cut.withColumnRenamed("hash", "_hash"), F.col("_row_hash") == F.col("_hash")).drop("_row_hash", "_hash")
