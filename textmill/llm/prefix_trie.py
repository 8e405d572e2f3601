"""Trie of all conversation prefixes, from the sorted conversations and the array of their common prefixes.

1. A turn becomes a key of 16 bytes (of the SHA-256 of role and text), so a conversation is a string of keys. Equal
   conversations are collapsed with their number, smallest id and the digest of their ids.
2. The different strings are range-partitioned into blocks. Within a block they are sorted, and the length of the
   prefix that each shares with the one before it (LCP) is an array; that across a block's border comes from the
   smallest and largest string of the blocks.
3. A node of the trie is a run of neighbours that share a prefix. All runs with branches are the nodes of the Cartesian
   tree of the LCP array, where nodes of one value under one parent are merged: the run of position i reaches to the
   nearest smaller values on both sides. These are found for all positions at once, within short pieces first and
   then over the minima of the pieces. Depths that no LCP has (chains without a branch) are put in from the depth of
   the parent on, as are the tails that belong to one string only.
4. In the order of first string and depth, the subtree of a node is a range of nodes. So members, leaves, children and
   saved bytes are differences of prefix sums, and the smallest member is a range minimum.
5. Runs that leave their block, at most as many as turns are shared across its two borders, are its unresolved ones.
   Of them, blocks send partial aggregates, and one pass in the order of blocks puts them together: a run ends in the
   first block whose border or inside has a smaller value. That is one row for each block and turn shared over a border.

Defined results: rows without conv_id belong to no conversation and are left out; turns of one conversation and number
are ordered by key; repeated rows are turns of their own; null role and text are empty; a base conversation that the
table does not have gives no turns; a conversation without turns is a member of the root alone; an empty table gives
no rows; other columns are ignored. A conversation is one row of 24 bytes a turn, so one task holds the longest of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import spread, stage

KEY = 16
#: Bytes of turn keys and sizes of a block, on average.
BLOCK_BYTES = 8 << 20
#: Ids that are joined at a time for the digest of the conversations that end at a node.
IDS = 4096
#: Length of the pieces whose minima are searched.
PIECE = 32
EMPTY = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: Nodes of a block. Those with ``open`` are partial: number and depth, sums without what other blocks have, and the size of the turn.
PARTIAL = NODE + ", block int, number long, parent long, open boolean, left boolean, right boolean, size long"
CLOSED = NODE + ", block int, number long, first boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as a key and the bytes of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * KEY))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("size")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def rebuilt(own: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % every in place of its own first h; h is crc32(c) % most."""
    base = own.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), 1, h)
    joined = own.join(base, F.col("conv_id") - F.col("conv_id") % every == F.col("_base"), "left")
    return joined.select("conv_id", F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the joined ids of each string; the pieces of a string come one after the other, in order."""
    now, held = None, None
    for batch in batches:
        done = []
        for seq, ids in zip(batch.column("_id").to_pylist(), batch.column("ids").to_pylist()):
            if seq != now:
                if held is not None:
                    done.append((now, held.hexdigest()))
                now, held = seq, hashlib.sha256()
            else:
                held.update(b",")
            held.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], ["_id", "ends"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([held.hexdigest()], pa.string())], ["_id", "ends"])


def strings(conversations: DataFrame) -> DataFrame:
    """(seq, sizes, n, conv, ends): the different conversations (conv_id, turns), with their number, smallest id and digest of ids.

    Ids are joined in pieces of a range of ids each, and only the pieces go to the task that hashes them one by one.
    """
    keyed = conversations.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), "")).alias("seq"), F.transform("turns", lambda t: t["size"]).alias("sizes"))
    keyed = stage(keyed.withColumn("_id", F.unhex(F.sha2("seq", 256))), "keyed")
    counted = keyed.groupBy("_id").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv"))
    pieces = keyed.groupBy("_id", F.floor(F.col("conv_id") / IDS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))  # at most IDS ids
    ends = pieces.repartition("_id").sortWithinPartitions("_id", "piece").select("_id", "ids").mapInArrow(_digest, "_id binary, ends string")
    # the smallest conversation stands for its string: each id is there once
    return keyed.join(counted, "_id").where("conv_id = conv").join(ends, "_id").select("seq", "sizes", "n", "conv", "ends")


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each position the nearest one before it with a smaller value, or -1: in its piece, else by the minima of pieces."""
    n = len(values)
    found = np.full(n, -1, np.int64)
    pieces = -(-n // PIECE)
    padded = np.full(pieces * PIECE, np.iinfo(np.int64).max)
    padded[:n] = values
    minima = padded.reshape(pieces, PIECE).min(axis=1)
    place = np.arange(n)
    open_ = np.ones(n, bool)
    for back in range(1, PIECE):
        at = np.flatnonzero(open_ & (place % PIECE >= back))
        hit = at[values[at - back] < values[at]]
        found[hit], open_[hit] = hit - back, False
    # minima of the 2^j pieces that end at each piece; a search steps back over as many as hold nothing smaller
    table = [minima]
    while (1 << len(table)) <= pieces:
        half = 1 << (len(table) - 1)
        table.append(np.concatenate([table[-1][:half], np.minimum(table[-1][half:], table[-1][:-half])]))
    at = np.flatnonzero(open_ & (place >= PIECE))
    piece = at // PIECE - 1
    for j in range(len(table) - 1, -1, -1):
        full = (piece >= (1 << j) - 1) & (piece >= 0)
        none = np.zeros(len(at), bool)
        none[full] = table[j][piece[full]] >= values[at[full]]
        piece = np.where(none, piece - (1 << j), piece)
    at, piece = at[piece >= 0], piece[piece >= 0]
    for back in range(PIECE - 1, -1, -1):
        candidate = piece * PIECE + back
        hit = (found[at] < 0) & (padded[candidate] < values[at])
        found[at[hit]] = candidate[hit]
    return found


def smaller_after(values: np.ndarray) -> np.ndarray:
    """For each position the nearest one after it with a smaller value, or the length."""
    return len(values) - 1 - smaller_before(values[::-1])[::-1]


class Minima:
    """Minimum of any range of values, from the minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        self.table = [values]
        while (1 << len(self.table)) <= len(values):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of positions first up to, not including, last."""
        level = np.frexp((last - first).astype(np.float64))[1] - 1
        out = np.zeros(len(first), np.int64)
        for j, t in enumerate(self.table):
            at = np.flatnonzero(level == j)
            out[at] = np.minimum(t[first[at]], t[last[at] - (1 << j)])
        return out


def shared(a: bytes, b: bytes) -> int:
    """Turns that two strings of keys have in common at their beginning."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (differ.bit_length() + 7) // 8) // KEY


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def nodes_of(seqs: list[bytes], sizes: list, n: np.ndarray, conv: np.ndarray, ends: list[str], before: int, after: int) -> dict[str, np.ndarray]:
    """The nodes of a block of sorted strings, in order of first string and depth. ``before`` and ``after`` are the turns shared across its borders, -1 at both ends."""
    rows = len(seqs)
    length = np.array([len(s) // KEY for s in seqs], np.int64)
    lcp = np.array([-1, *(shared(a, b) for a, b in zip(seqs, seqs[1:]))], np.int64)
    left, right = smaller_before(lcp), smaller_after(lcp)
    following = np.append(lcp[1:], -1)

    # runs: one for each left end and LCP value, so equal values under one parent are merged; each from the depth of its parent on
    at = np.arange(1, rows)
    key = left[at] * (int(length.max(initial=0)) + 1) + lcp[at]
    _, first, merged = np.unique(key, return_index=True, return_counts=True)
    at = at[first]
    start, stop, deep = left[at], right[at], lcp[at]
    high = np.maximum(lcp[start], np.where(stop < rows, lcp[np.minimum(stop, rows - 1)], -1))
    # tails: the depths of one string only
    tail = np.flatnonzero(length > np.maximum(lcp, following))
    start, stop, deep = np.concatenate([start, tail]), np.concatenate([stop, tail + 1]), np.concatenate([deep, length[tail]])
    high = np.concatenate([high, np.maximum(lcp, following)[tail]])
    branches = np.concatenate([merged, np.zeros(len(tail), np.int64)])

    # missing depths: one node for each depth of a run
    run = np.repeat(np.arange(len(start)), deep - high)
    depth = high[run] + 1 + _ranges(deep - high)
    order = np.lexsort((depth, start[run]))
    run, depth = run[order], depth[order]
    first, last = start[run], stop[run]
    begin = np.searchsorted(first, np.arange(rows + 1))
    parent = np.arange(len(depth)) - 1
    top = depth == lcp[first] + 1
    up = first[top]
    parent[top] = np.where(depth[top] > 0, begin[np.maximum(left[up], 0)] + lcp[up] - lcp[np.maximum(left[up], 0)] - 1, -1)

    goes_left, goes_right = (first == 0) & (depth <= before), (last == rows) & (depth <= after)
    partial = goes_left | goes_right
    total = np.concatenate([[0], np.cumsum(n)])
    leaf = np.concatenate([[0], np.cumsum(length > np.append(lcp[1:], after))])
    convs = total[last] - total[first]
    # a first child lies below the first string, if the node begins here; others are counted by the values that are merged
    children = np.where(depth == deep[run], branches[run], 0) + np.where(goes_left, depth == before, length[first] > depth)
    flat = np.concatenate([np.zeros(1, np.int64), *(np.asarray(s, np.int64) for s in sizes)])
    offset = np.concatenate([[0], np.cumsum(length)])
    size = np.where(depth > 0, flat[offset[first] + depth], 0)  # the root has no text
    own = np.where(partial, 0, (convs - 1) * size)
    sums = np.concatenate([[0], np.cumsum(own)])
    number = np.arange(len(depth))
    digest = np.array(ends, object)
    ending = length[first] == depth  # a string sorts before those it is a prefix of
    return {
        "conv": Minima(conv).of(first, last), "depth": depth, "parent": parent, "convs": convs, "children": children, "leaves": leaf[last] - leaf[first], "saved": sums[begin[last]] - sums[number],
        "ends": np.where(ending, digest[first], EMPTY), "partial": partial, "left": goes_left, "right": goes_right, "size": size,
    }


def _block(borders: dict[int, tuple[int, int]]):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        seqs = table.column("seq").to_pylist()
        order = sorted(range(len(seqs)), key=seqs.__getitem__)
        sizes, ends = table.column("sizes").to_pylist(), table.column("ends").to_pylist()
        n, conv = (table.column(c).to_numpy()[order] for c in ("n", "conv"))
        found = nodes_of([seqs[i] for i in order], [sizes[i] for i in order], n, conv, [ends[i] for i in order], *borders[block])
        up, partial, count = found["parent"], found["partial"], len(found["depth"])
        # the id of a parent inside the block is known; that of one which leaves it is filled in later
        known = (up >= 0) & ~partial[up] & ~partial
        columns = [found["conv"], found["depth"], pa.array(found["conv"][up], pa.int64(), mask=~known), found["convs"], found["children"], found["leaves"], found["saved"], pa.array(found["ends"], pa.string())]
        columns += [np.full(count, block, np.int32), np.arange(count), pa.array(up, pa.int64(), mask=known | partial | (up < 0)), partial, found["left"], found["right"], found["size"]]
        return pa.Table.from_arrays([pa.array(c) for c in columns], "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256 block number parent open left right size".split())

    return run


def _close(table: pa.Table) -> pa.Table:
    """Puts partial nodes together, in the order of blocks and depths: a stack of the nodes that reach into the next block."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["block"], not r["left"], r["depth"]))
    nodes: list[dict] = []  # whole nodes, with the sums over those below that are whole only now
    stack: list[int] = []
    of_row = []

    def pop() -> None:
        node = nodes[stack.pop()]
        own = (node["n_convs"] - 1) * node["size"]
        node["below"] += own
        node["saved_tokens"] += node["below"]
        if stack:
            nodes[stack[-1]]["below"] += node["below"]

    i = 0
    while i < len(rows):
        block = rows[i]["block"]
        same = []
        while i < len(rows) and rows[i]["block"] == block:
            same.append(rows[i])
            i += 1
        for r in same:
            if r["left"]:
                node = nodes[stack[r["depth"]]]
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    node[c] += r[c]
                node["conv_id"] = min(node["conv_id"], r["conv_id"])
                of_row.append((r, stack[r["depth"]], False))
        # those that came from the left and end here, before those that begin here are put on top
        through = sum(r["left"] and r["right"] for r in same)
        begun = [r for r in same if not r["left"]]
        while len(stack) > through:
            pop()
        for r in begun:
            nodes.append({**r, "below": 0, "up": stack[-1] if stack else None})
            stack.append(len(nodes) - 1)
            of_row.append((r, stack[-1], True))
    while stack:
        pop()
    out = []
    for r, k, first in of_row:
        node = nodes[k]
        up = nodes[node["up"]]["conv_id"] if node["up"] is not None else None
        out.append({c: node[c] for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")} | {"parent_conv_id": up, "block": r["block"], "number": r["number"], "first": first})
    kinds = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("block", pa.int32()), ("number", pa.int64()), ("first", pa.bool_())])
    return pa.Table.from_pylist(out, schema=kinds)


def trie(sequences: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns), one row each."""
    spark = sequences.sparkSession
    different = stage(strings(sequences), "strings")
    size = different.agg(F.coalesce(F.sum(F.octet_length("seq") * 2 + 100), F.lit(0)).alias("n")).first()["n"]
    placed = stage(different.repartitionByRange(spread(spark, size, block_bytes), "seq").withColumn("block", F.spark_partition_id()), "placed")
    # two strings for each block
    heads = [tuple(r) for r in placed.groupBy("block").agg(F.min("seq"), F.max("seq")).orderBy("block").collect()]
    between = [-1, *(shared(bytes(a[2]), bytes(b[1])) for a, b in zip(heads, heads[1:])), -1]
    borders = {h[0]: (between[i], between[i + 1]) for i, h in enumerate(heads)}
    nodes = stage(placed.groupBy("block").applyInArrow(_block(borders), PARTIAL), "nodes")
    closed = stage(nodes.where("open").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_close, CLOSED), "closed")
    inside = nodes.where("not open and parent is null")
    under = nodes.where("not open and parent is not null").drop("parent_conv_id").join(closed.select("block", F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id")), ["block", "parent"])
    names = [c.split()[0] for c in NODE.split(", ")]
    return inside.select(names).unionByName(under.select(names)).unionByName(closed.where("first").select(names))
