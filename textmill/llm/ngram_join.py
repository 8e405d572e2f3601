"""N-gram Jaccard join of texts by a token-group matrix: links, as classes of texts that they connect.

Texts are sets of hashes of their runs of SIZE words. Sets are partitioned into groups of similar ones: those with
the same smallest hash, as two sets have it in common as often as their Jaccard similarity says. The matrix of
tokens and groups holds the union of each group's tokens; it is never stored, but dealt by token into parts.

1. Equal texts are collapsed; the others are dealt into blocks by their hash.
2. Blocks send the tokens of the even half of the token space to the parts, each once: with its group if one group
   of the block holds it, else with their number. A part answers how many groups hold the token. A text that links
   to one of another group shares all but a quarter of its tokens with it, so among any quarter and one more of its
   tokens is one of that group's. Texts choose those that fewest groups hold, in one order for all; tokens of a
   single group bound the overlap with all other groups, and most texts end here: no group holds enough of them.
3. Members of a group meet in its cells, of SHARD texts at most. One pivot text visits all cells of a group.
4. The rest say which other groups may hold enough of them. For each token they chose, the cell with most texts there
   is opened, and the others visit it: their overlap with its union of tokens is counted first, and that with its
   members only if it is enough. No pairs of texts or groups are formed. A token is done when links connect all its
   texts; after ROUNDS such rounds the texts of each of the others, in different classes still and of sizes and numbers
   of shared tokens that can link, meet as one list, once for all tokens of the same texts.
5. Divided groups with texts that the pivot's class lacks go through the steps 2 and 4 with tokens counted by text.
6. Connected components of the links are found by hooking to the smallest neighbour and pointer jumping, as tables.

A cell with many visitors is copied for each SHARD of them. A token that many texts hold sends one row from each
block. Links are found whole: no cap, and no hash decides but for the equality of 64-bit hashes of shingles.

Defined results: words are lower-cased (A-Z); a text with fewer than SIZE words is one shingle of all its words;
null texts and texts without words have an empty set, link to nothing, and are each their own class; equal rows are
linked (unless empty); null ids count in no minimum; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .bytehash import Joined, shingles
from .common import SLICE_BYTES, passing, spread, stage
from .suffix_dedup import _collapse, _table, _texts

SIZE, PERCENT = 5, 75
BLOCK_BYTES, PART_TOKENS = 16 << 20, 4 << 20
SHARD, ROUNDS = 2000, 2
#: Answers above 1 are 2 and quarter steps of the logarithm of the number of groups.
SINGLE = 1


def misses(n: np.ndarray) -> np.ndarray:
    """How many tokens a set of n may not share with a set that it links to."""
    return n - -(-n * PERCENT // 100)


def token_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    start, held = 0, 0

    def some(part: list[bytes]) -> Iterator[np.ndarray]:
        hashes, owners = shingles(*Joined(part, True).words(), size)
        order = np.argsort(owners, kind="stable")
        hashes, edges = hashes[order], np.searchsorted(owners[order], np.arange(len(part) + 1)).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            s = np.sort(hashes[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if b > a else s

    for i, t in enumerate(texts):
        if held and held + len(t) > SLICE_BYTES:
            yield from some(texts[start:i])
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield from some(texts[start:])


def _part(tokens: np.ndarray, parts: int) -> np.ndarray:
    """From the lower 24 bits; the upper 40 travel."""
    return ((tokens & np.uint64(0xFFFFFF)) >> np.uint64(1)).astype(np.int64) * parts >> 23


def _short(tokens: np.ndarray) -> bytes:
    return np.ascontiguousarray((tokens >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _long(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _counted_half(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The even tokens of all sets in a row, and the set of each."""
    even = [s[(s & np.uint64(1)) == 0] for s in sets]
    return np.concatenate([np.zeros(0, np.uint64), *even]), np.repeat(np.arange(len(sets)), [len(e) for e in even])


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _edges(to: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, begin, end) of the sorted parts that have something."""
    cuts = np.searchsorted(to, np.arange(parts + 1)).tolist()
    return ((p, a, b) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a)


def _ids(table: pa.Table, names: list[str]) -> np.ndarray:
    """Numbers of the texts of a block: given, or the block and their place in it."""
    if "id" in table.column_names:
        given = dict(zip(table.column("hash").to_pylist(), table.column("id").to_pylist()))
        return np.array([given[h] for h in names], np.int64)
    return (np.int64(table.column("block")[0].as_py()) << 32) + np.arange(len(names), dtype=np.int64)


def _groups(table: pa.Table, names: list[str], sets: list[np.ndarray]) -> np.ndarray:
    """The smallest hash of each set; where ids are given, each text is its own group."""
    return _ids(table, names).view(np.uint64) if "id" in table.column_names else np.array([s[0] if len(s) else 0 for s in sets], np.uint64)


def _travelling(sets: list[np.ndarray], groups: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """The different even tokens of a block as they travel: by part, first those of one group, by group.

    With their parts, whether several groups of the block hold them, the smallest of these and their number.
    """
    tokens, owner = _counted_half(sets)
    order = np.argsort(tokens, kind="stable")
    t, g = tokens[order], groups[owner[order]]
    first = _firsts(t)
    if not len(first):
        return t, np.zeros(0, np.int64), np.zeros(0, bool), g, np.zeros(0, np.uint32)
    least = np.minimum.reduceat(g, first)
    several = least != np.maximum.reduceat(g, first)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
    inside = np.flatnonzero(several[run])
    inside = inside[np.lexsort((g[inside], run[inside]))]
    r, h = run[inside], g[inside]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    counts = np.maximum(np.bincount(r[new], minlength=len(first)), 1).astype(np.uint32)
    u = t[first]
    to = _part(u, parts)
    order = np.lexsort((u, np.where(several, 0, least), several, to))
    return u[order], to[order], several[order], least[order], counts[order]


def _ask(parts: int, size: int):
    def run(table: pa.Table) -> pa.Table:
        raw, _, names = _texts(table)
        sets = list(token_sets(raw, size))
        tokens, to, several, groups, counts = _travelling(sets, _groups(table, names, sets), parts)
        rows, block = [], table.column("block")[0].as_py()
        for p, a, b in _edges(to, parts):
            own = groups[a:b][~several[a:b]]
            first = _firsts(own)
            rows.append((p, block, _short(tokens[a:b]), np.diff(np.append(first, len(own))).astype(np.uint32).tobytes(), own[first].tobytes(), counts[a:b][several[a:b]].tobytes()))
        return _table(rows, "part block tokens runs groups many", pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    return run


def _tell(table: pa.Table) -> pa.Table:
    """For each token sent, in the order sent, how common it is: SINGLE if one group holds it."""
    sent = [(_long(t), np.frombuffer(r, np.uint32), np.frombuffer(g, np.uint64), np.frombuffer(m, np.uint32)) for t, r, g, m in zip(*(table.column(c).to_pylist() for c in ("tokens", "runs", "groups", "many")))]
    t = np.concatenate([x[0] for x in sent])
    groups = np.concatenate([np.append(np.repeat(g, r), np.zeros(len(m), np.uint64)) for _, r, g, m in sent])
    weight = np.concatenate([np.append(np.ones(len(t) - len(m), np.int64), m) for t, _, _, m in sent])
    order = np.argsort(t)
    first = _firsts(t[order])
    held = np.add.reduceat(weight[order], first)
    alone = (np.minimum.reduceat(groups[order], first) == np.maximum.reduceat(groups[order], first)) & (np.maximum.reduceat(weight[order], first) == 1)
    level = np.where(alone, SINGLE, np.minimum(250, 2 + 4 * np.log2(held))).astype(np.uint8)
    told = np.empty(len(t), np.uint8)
    told[order] = np.repeat(level, np.diff(np.append(first, len(t))))
    edges = np.cumsum([0, *(len(x[0]) for x in sent)])
    return _table([(p, b, told[x:y].tobytes()) for p, b, x, y in zip(table.column("part").to_pylist(), table.column("block").to_pylist(), edges[:-1], edges[1:])], "part block levels", pa.int32(), pa.int32(), pa.binary())


#: What ``_probe`` gives: all sets of a block; its chosen tokens, each with its text; the tokens of texts that chose some.
SETS, CHOSEN, OPEN = 0, 1, 2
PROBES = "kind int, block int, id long, hashes array<string>, ids binary, sizes binary, shared binary, groups binary, tokens binary"
_PROBES = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), *[pa.binary()] * 5)


def _probe(parts: int, size: int):
    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        names_of = "kind block id hashes ids sizes shared groups tokens"
        if not texts.num_rows:
            return _table([], names_of, *_PROBES)
        block = texts.column("block")[0].as_py()
        raw, _, names = _texts(texts)
        sets, ids = list(token_sets(raw, size)), _ids(texts, names)
        n = np.array([len(s) for s in sets], np.int64)
        groups = _groups(texts, names, sets)
        different = _travelling(sets, groups, parts)[0]
        answers = dict(zip(told.column("part").to_pylist(), told.column("levels").to_pylist()))
        order = np.argsort(different)
        level_of = np.frombuffer(b"".join(answers[p] for p in sorted(answers)), np.uint8)[order]
        different = different[order]
        need = (misses(n) + 1).tolist()
        shared, chosen, of, rows = n.copy(), [], [], []
        for i, (s, p) in enumerate(zip(sets, need)):
            even = s[(s & np.uint64(1)) == 0]
            level = level_of[np.searchsorted(different, even)]
            rest = np.flatnonzero(level != SINGLE)
            single = len(even) - len(rest)
            shared[i] -= single
            if single >= p or not len(s):
                continue
            picked = even[rest[np.lexsort((even[rest], level[rest]))[: p - single]]]
            if len(even) < p:  # too few even tokens: the order goes on with the odd ones
                picked = np.concatenate([picked, s[(s & np.uint64(1)) == 1][: p - len(even)]])
            chosen.append(picked)
            of.append(np.full(len(picked), i))
            rows.append((OPEN, block, int(ids[i]), *[None] * 5, s.tobytes()))
        opened = np.isin(np.arange(len(sets)), [o[0] for o in of])
        rows.append((SETS, block, None, names, ids.tobytes(), n.astype(np.uint32).tobytes(), np.where(opened, shared, 0).astype(np.uint32).tobytes(), groups.tobytes(), None))
        if of:
            t, o = np.concatenate(chosen), np.concatenate(of)
            rows.append((CHOSEN, block, None, None, ids[o].tobytes(), None, None, None, t.tobytes()))
        return _table(rows, names_of, *_PROBES)

    return run


OFFERS = "kind int, part int, block int, tokens binary, cells binary, counts binary, classes binary, ids binary, sizes binary, shared binary"
_OFFERS = (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 7)
#: Kinds of offers: to a part, one row a token; what the block keeps of them; to a part, each text.
SUMMARY, KEPT, EACH = 0, 1, 2


def _offer(parts: int):
    """Per token that texts of a block chose: the cell with most of them, how many it has, and their class or 0 if there are several."""

    def run(chosen: pa.Table, state: pa.Table) -> pa.Table:
        names_of = "kind part block tokens cells counts classes ids sizes shared"
        if not chosen.num_rows:
            return _table([], names_of, *_OFFERS)
        block = chosen.column("block")[0].as_py()
        ids, t = (np.concatenate([np.frombuffer(x, kind) for x in chosen.column(c).to_pylist()]) for c, kind in (("ids", np.int64), ("tokens", np.uint64)))
        known = {c: state.column(c).to_numpy() for c in ("id", "cell", "class", "n", "shared")}
        order = np.argsort(known["id"])
        at = order[np.searchsorted(known["id"], ids, sorter=order)]
        cells, classes = known["cell"][at], known["class"][at]
        to = _part(t, parts)
        order = np.lexsort((cells, t, to))
        t, to, cells, classes, ids, at = t[order], to[order], cells[order], classes[order], ids[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (cells[1:] != cells[:-1])]))
        counts = np.diff(np.append(first, len(t)))
        token = _firsts(t[first])  # among the (token, cell) runs
        best = np.lexsort((cells[first], -counts, np.repeat(np.arange(len(token)), np.diff(np.append(token, len(first))))))[token]
        runs = first[token]
        low, high = np.minimum.reduceat(classes, runs), np.maximum.reduceat(classes, runs)
        u, of = t[runs], to[runs]
        rows = [(SUMMARY, p, block, u[a:b].tobytes(), cells[first][best][a:b].tobytes(), counts[best][a:b].astype(np.uint32).tobytes(), np.where(low == high, low, SEVERAL)[a:b].tobytes(), None, None, None) for p, a, b in _edges(of, parts)]
        rows.append((KEPT, None, block, t.tobytes(), cells.tobytes(), None, classes.tobytes(), ids.tobytes(), known["n"][at].astype(np.uint32).tobytes(), known["shared"][at].astype(np.uint32).tobytes()))
        return _table(rows, names_of, *_OFFERS)

    return run


SEVERAL = -1


def _hub(table: pa.Table) -> pa.Table:
    """For each token offered, in the order sent: its cell with most texts, and whether its texts are of several classes."""
    sent = [(np.frombuffer(t, np.uint64), np.frombuffer(c, np.int64), np.frombuffer(n, np.uint32), np.frombuffer(k, np.int64)) for t, c, n, k in zip(*(table.column(x).to_pylist() for x in ("tokens", "cells", "counts", "classes")))]
    t, c, n, k = (np.concatenate([x[i] for x in sent]) for i in range(4))
    order = np.lexsort((c, t))
    ts, cs, ns, ks = t[order], c[order], n[order].astype(np.int64), k[order]
    pair = np.flatnonzero(np.concatenate([[True], (ts[1:] != ts[:-1]) | (cs[1:] != cs[:-1])]))
    held = np.add.reduceat(ns, pair)
    token = _firsts(ts[pair])
    best = np.lexsort((cs[pair], -held, np.repeat(np.arange(len(token)), np.diff(np.append(token, len(pair))))))[token]
    runs = pair[token]
    low, high = np.minimum.reduceat(ks, runs), np.maximum.reduceat(ks, runs)
    at = np.searchsorted(ts[runs], t)
    hubs, mixed = cs[pair][best][at], ((low != high) | (low == SEVERAL))[at]
    edges = np.cumsum([0, *(len(x[0]) for x in sent)])
    return _table([(p, b, hubs[x:y].tobytes(), mixed[x:y].tobytes()) for p, b, x, y in zip(table.column("part").to_pylist(), table.column("block").to_pylist(), edges[:-1], edges[1:])], "part block hubs mixed", pa.int32(), pa.int32(), pa.binary(), pa.binary())


#: Kinds of choices: a text that visits a cell; the tokens of a block that are not done, with their texts.
VISIT, LEFT = 0, 1
CHOICES = "kind int, part int, block int, id long, home long, tokens binary, ids binary, cells binary, classes binary, sizes binary, shared binary"


def _choose(parts: int, last: bool):
    """Visits to the opened cells, and what is left; in the last round all texts of tokens that are not done, by part."""

    def run(kept: pa.Table, told: pa.Table) -> pa.Table:
        names_of, kinds = "kind part block id home tokens ids cells classes sizes shared", (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 6)
        if not kept.num_rows:
            return _table([], names_of, *kinds)
        block = kept.column("block")[0].as_py()
        t, cells, classes, ids, n, shared = (np.frombuffer(kept.column(c)[0].as_py(), kind) for c, kind in (("tokens", np.uint64), ("cells", np.int64), ("classes", np.int64), ("ids", np.int64), ("sizes", np.uint32), ("shared", np.uint32)))
        by_part = sorted(zip(*(told.column(c).to_pylist() for c in ("part", "hubs", "mixed"))))
        hubs, mixed = np.frombuffer(b"".join(x[1] for x in by_part), np.int64), np.frombuffer(b"".join(x[2] for x in by_part), bool)
        lengths = np.diff(np.append(_firsts(t), len(t)))
        away = np.repeat(mixed, lengths) & ((cells != np.repeat(hubs, lengths)) | last)
        if last:
            to = _part(t[away], parts)
            columns = [x[away] for x in (t, ids, cells, classes, n, shared)]
            return _table([(LEFT, p, block, None, None, *(x[a:b].tobytes() for x in columns)) for p, a, b in _edges(to, parts)], names_of, *kinds)
        ways = np.unique(np.stack([ids[away], np.repeat(hubs, lengths)[away]]), axis=1) if away.any() else np.zeros((2, 0), np.int64)
        rows = [(VISIT, None, block, i, h, *[None] * 6) for i, h in ways.T.tolist()]
        if away.any():
            rows.append((LEFT, None, block, None, None, t[away].tobytes(), ids[away].tobytes(), None, None, None, None))
        return _table(rows, names_of, *kinds)

    return run


MEETINGS = "home long, role int, ids array<long>"


def _partnered(n: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes and numbers of shared tokens include one that each can link to (itself, perhaps)."""
    # the overlap is at most what either shares with anything, and has to be 75 of 175 of both sizes
    most = (100 + PERCENT) * shared // PERCENT - n
    by = np.argsort(-most, kind="stable")
    least = np.minimum.accumulate(n[by])
    able = np.searchsorted(-most[by], -n, "right")
    return (able > 0) & (least[np.maximum(able, 1) - 1] <= most)


def _meetings(table: pa.Table) -> pa.Table:
    """Lists of texts that hold one token, in different cells and classes, and can link: once for all tokens of the same texts.

    A list of more than SHARD is cut, and each two pieces of it meet at a home of their own.
    """
    t, ids, cells, classes, n, shared = (np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]) for c, kind in (("tokens", np.uint64), ("ids", np.int64), ("cells", np.int64), ("classes", np.int64), ("sizes", np.uint32), ("shared", np.uint32)))
    order = np.lexsort((ids, classes, t))
    t, ids, cells, classes = t[order], ids[order], cells[order], classes[order]
    n, shared = n[order].astype(np.int64), shared[order].astype(np.int64)
    first = _firsts(t)
    found: dict[bytes, tuple] = {}
    for a, b in zip(first.tolist(), np.append(first, len(t))[1:].tolist()):
        if classes[a] == classes[b - 1]:
            continue
        at = a + np.flatnonzero(_partnered(n[a:b], shared[a:b]))
        pieces = [at[x : x + SHARD] for x in range(0, len(at), SHARD)]
        for x, low in enumerate(pieces):
            for high in pieces[x:]:
                both = cells[low[0]] == cells[low], cells[low[0]] == cells[high]
                if classes[low[0]] == classes[high[-1]] or both[0].all() and both[1].all():
                    continue
                key = hashlib.blake2b(ids[low].tobytes() + b"/" + ids[high].tobytes(), digest_size=8).digest()
                found[key] = ids[low], None if high is low else ids[high]
    rows = [(int.from_bytes(key, "little", signed=True), role, x.tolist()) for key, both in found.items() for role, x in zip((MEMBER, VISITOR), both) if x is not None]
    return _table(rows, "home role ids", pa.int64(), pa.int32(), pa.list_(pa.int64()))


def _fetch(size: int):
    """The sets of the texts that have to go somewhere, one row for each way (hash, id, home, role)."""

    def run(texts: pa.Table, ways: pa.Table) -> pa.Table:
        names_of, kinds = "home role id tokens", (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        if not texts.num_rows or not ways.num_rows:
            return _table([], names_of, *kinds)
        wanted: dict[str, list[tuple]] = {}
        for h, *way in zip(*(ways.column(c).to_pylist() for c in ("hash", "home", "role", "id"))):
            wanted.setdefault(h, []).append(way)
        raw, _, names = _texts(texts)
        chosen = [k for k, h in enumerate(names) if h in wanted]
        rows = []
        for k, s in zip(chosen, token_sets([raw[k] for k in chosen], size)):
            data = s.tobytes()
            rows += [(*way, data) for way in wanted[names[k]]]
        return _table(rows, names_of, *kinds)

    return run


MEMBER, VISITOR, PIVOT = 0, 1, 2
LINKS = "a long, b long"


def links_of(sets: list[np.ndarray], roles: list[int], names: list, classes: list | None = None, within: bool = False) -> list[tuple]:
    """Links that connect what the texts of one cell connect: of visitors to members, and of members, unless their classes are known; with ``within`` of members of different ones too."""
    members = [i for i, r in enumerate(roles) if r == MEMBER]
    sizes = np.array([len(sets[i]) for i in members], np.int64)
    tokens = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in members)])
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    union, length = tokens[first], np.diff(np.append(first, len(tokens)))
    root = np.arange(len(members)) if classes is None else np.unique([classes[i] for i in members], return_inverse=True)[1].ravel()
    found: list[tuple] = []

    def query(s: np.ndarray) -> np.ndarray:
        """Members that the set links to."""
        if not len(union) or not len(s):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(union, s), len(union) - 1)
        at = at[union[at] == s]
        if len(at) * 100 < len(s) * PERCENT:  # not enough of it in the union of all
            return np.zeros(0, np.int64)
        n = length[at]
        rows = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        inter = np.bincount(owner[rows], minlength=len(members))
        return np.flatnonzero(100 * inter >= PERCENT * (len(s) + sizes - inter))

    def join(i: int, linked: np.ndarray) -> None:
        for r in np.unique(root[linked]).tolist():
            if r != root[i]:
                found.append((names[members[i]], names[members[int(linked[root[linked] == r][0])]]))
                root[root == r] = root[i]

    if members and (classes is None or within):
        join(0, query(sets[members[0]]))
        largest = int(np.flatnonzero(root == np.bincount(root).argmax())[0])
        for i in range(1, len(members)):
            if root[i] != root[largest]:
                join(i, query(sets[members[i]]))
    for i, r in enumerate(roles):
        if r != MEMBER:
            linked = query(sets[i])
            for k in np.unique(root[linked], return_index=True)[1].tolist():
                found.append((names[i], names[members[int(linked[k])]]))
    return found


def _links(table: pa.Table, within: bool) -> pa.Table:
    columns = [c for c in ("role", "id", "tokens", "class") if c in table.column_names]
    rows = sorted(zip(*(table.column(c).to_pylist() for c in columns)))
    found = links_of([np.frombuffer(r[2], np.uint64) for r in rows], [r[0] for r in rows], [r[1] for r in rows], [r[3] for r in rows] if "class" in columns else None, within)
    return _table(found, "a b", pa.int64(), pa.int64())


def _verify(table: pa.Table) -> pa.Table:
    return _links(table, within=False)


def _verify_all(table: pa.Table) -> pa.Table:
    return _links(table, within=True)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for all nodes of the links (a, b): root is the smallest node that links reach."""
    edges = stage(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "links")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("root").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        # what a root itself found goes to all that point at it, then pointers jump
        told = hooked.groupBy(F.col("root").alias("r")).agg(F.min("next").alias("best"))
        lower = hooked.join(told, hooked.root == told.r).select("node", F.col("root").alias("was"), F.least("next", "best").alias("up"))
        jump = lower.select(F.col("node").alias("j"), F.col("up").alias("jumped"))
        new = stage(lower.join(jump, lower.up == jump.j, "left").select("node", "was", F.least("up", F.coalesce("jumped", "up")).alias("root")), "labels")
        labels = new.select("node", "root")
        if new.where("was != root").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, names, ids, n, shared, g in zip(*(batch.column(c).to_pylist() for c in ("block", "hashes", "ids", "sizes", "shared", "groups"))):
            wide = [pa.array(np.frombuffer(x, np.uint32).astype(np.int64)) for x in (n, shared)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.frombuffer(ids, np.int64)), pa.array([block] * len(names), pa.int32()), *wide, pa.array(np.frombuffer(g, np.int64))], ["hash", "id", "block", "n", "shared", "grp"])


def _matrix(dealt: DataFrame, parts: int, size: int) -> tuple[DataFrame, DataFrame]:
    """What ``_probe`` gives for all blocks, and its SETS as rows; shared is 0 for texts that link to no other group."""
    asked = dealt.groupBy("block").applyInArrow(_ask(parts, size), "part int, block int, tokens binary, runs binary, groups binary, many binary")
    told = asked.groupBy("part").applyInArrow(_tell, "part int, block int, levels binary")
    probes = stage(dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_probe(parts, size), PROBES), "probes")
    return probes, stage(probes.where(F.col("kind") == SETS).mapInArrow(_unpack, "hash string, id long, block int, n long, shared long, grp long"), "sets")


def _across(probes: DataFrame, cells: DataFrame, found: DataFrame, near: DataFrame, parts: int) -> DataFrame:
    """``found`` with the links between texts of different cells (id, block, n, shared, cell); near: the classes of ``found``."""
    opened = probes.where(F.col("kind") == OPEN).select("id", "tokens")
    left = probes.where(F.col("kind") == CHOSEN).select("block", "ids", "tokens")
    for turn in range(ROUNDS + 1):
        last = turn == ROUNDS
        near = components(found) if turn else near
        state = stage(cells.join(near.withColumnRenamed("node", "id"), "id", "left").select("block", "id", "cell", F.coalesce("root", "id").alias("class"), "n", "shared"), "state")
        offers = stage(left.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_offer(parts), OFFERS), "offers")
        hubs = offers.where(F.col("kind") == SUMMARY).groupBy("part").applyInArrow(_hub, "part int, block int, hubs binary, mixed binary")
        choices = offers.where(F.col("kind") == KEPT).groupBy("block").cogroup(hubs.groupBy("block")).applyInArrow(_choose(parts, last), CHOICES)
        choices = stage(choices, "choices")
        if last:
            # lists of two parts with one home are equal, or else all meet there
            lists = stage(choices.groupBy("part").applyInArrow(_meetings, MEETINGS).distinct(), "meetings")
            met = lists.select("home", "role", F.explode("ids").alias("id")).join(state.select("id", "class"), "id").join(opened, "id")
            return stage(found.union(met.groupBy("home").applyInArrow(_verify_all, LINKS)), "found")
        visits = stage(choices.where(F.col("kind") == VISIT).select("id", "home"), "visits")
        if visits.isEmpty():
            return found
        copies = visits.groupBy("home").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("copies"))
        seat = F.pmod(F.xxhash64("id"), F.col("copies"))
        guests = visits.join(copies, "home").select("id", "home", seat.alias("seat"), F.lit(VISITOR).alias("role"), F.lit(0).cast("long").alias("class"))
        hosts = state.join(copies, state.cell == copies.home).select("id", "home", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("seat"), F.lit(MEMBER).alias("role"), "class")
        met = guests.union(hosts).join(opened, "id").groupBy("home", "seat").applyInArrow(_verify, LINKS)
        found = stage(found.union(met), "found")
        left = choices.where(F.col("kind") == LEFT).select("block", "ids", "tokens")
    return found


#: Bits of a bitmap for each text in it, up to MOST_BITS; beyond that more texts than those travel.
BITS, MOST_BITS, BUCKET = 16, 1 << 29, 1 << 15


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """One bit for each of the MD5 hashes, at a place that their first 15 digits say."""
    size = max(BUCKET, min(MOST_BITS, 1 << (BITS * hashes.count()).bit_length()))
    spot = F.conv(F.left("hash", F.lit(15)), 16, 10).cast("long") % size
    # at most MOST_BITS / BUCKET rows of 4 KB
    rows = hashes.select(spot.alias("spot")).groupBy(F.floor(F.col("spot") / BUCKET).alias("bucket")).agg(F.bitmap_construct_agg(F.col("spot") % BUCKET).alias("bits")).collect()
    bits = np.zeros((size // BUCKET, BUCKET // 8), np.uint8)
    for r in rows:
        bits[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.ravel()


def _different(docs: DataFrame, text: Column, blocks: int, wanted: DataFrame | None = None) -> DataFrame:
    """(hash, text, copies, block) of the texts of a task; with ``wanted`` (hash) of those only and a few others, so that the rest are not shuffled."""
    shared = None if wanted is None else docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _collapse(batches):
            spots = np.array([int(h[:15], 16) for h in batch.column("hash").to_pylist()], np.int64) % (8 * len(shared.value))
            yield batch.filter(pa.array((shared.value[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)))

    found = docs.select(text.alias("text")).mapInArrow(_collapse if wanted is None else run, "hash string, text binary, copies long")
    return found.withColumn("block", F.pmod(F.xxhash64("hash"), F.lit(blocks)).cast("int"))


def _classes(docs: DataFrame, text: Column, blocks: int, parts: int, size: int) -> DataFrame:
    """(_hash, _shingles, _component, _class) of each different text; it reads one staged table."""
    dealt = _different(docs, text, blocks).repartition(blocks, "block")
    probes, sets = _matrix(dealt, parts, size)

    groups = sets.where("n > 0").groupBy("grp").agg(F.count("*").alias("texts"), F.min("id").alias("pivot"))
    groups = groups.withColumn("shards", F.ceil(F.col("texts") / SHARD).cast("int"))

    def cell(shard: Column) -> Column:
        return F.when(F.col("shards") == 1, F.col("grp")).otherwise(F.xxhash64("grp", shard))

    seated = stage(sets.where("n > 0").join(groups, "grp").withColumn("cell", cell(F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))), "seated")
    own = seated.where("texts > 1").select("block", "hash", "id", F.col("cell").alias("home"), F.lit(MEMBER).alias("role"))
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    pivots = seated.where("shards > 1 and id = pivot").select("block", "hash", "id", "grp", "shards", every).select("block", "hash", "id", cell(F.col("shard")).alias("home"), F.lit(PIVOT).alias("role"))
    grouped = _different(docs, text, blocks, seated.where("texts > 1").select("hash")).repartition(blocks, "block")
    fetched = grouped.groupBy("block").cogroup(own.union(pivots).groupBy("block")).applyInArrow(_fetch(size), "home long, role int, id long, tokens binary")
    found = stage(fetched.groupBy("home").applyInArrow(_verify, LINKS), "found")

    near = components(found)
    open_cells = seated.where("shared > 0").select("id", "block", "n", "shared", "cell")
    found, inner = _across(probes, open_cells, found, near, parts), found
    divided = seated.where("shards > 1")
    if not divided.isEmpty():
        # groups with texts that the pivot's class lacks: each of their texts is its own group now
        known = stage(divided.select("hash", "id", "grp", "pivot", "cell").join(near.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("root", "id")), "known")
        leading = known.where("id = pivot").select("grp", F.col("class").alias("leading"))
        loose = known.join(leading, "grp").where("class != leading").select("grp").distinct()
        again = known.join(loose, "grp", "left_semi").select("hash", "id", "cell")
        if not again.isEmpty():
            again = stage(again, "again")
            alone = _different(docs, text, blocks, again).join(again.drop("cell"), "hash").repartition(blocks, "block")
            more, each = _matrix(alone, parts, size)
            cells = each.where("shared > 0").select("id", "block", "n", "shared").join(again.select("id", "cell"), "id")
            found = found.union(_across(more, cells, inner, near, parts))
    roots = components(found)

    ids = docs.select(F.col("doc_id").alias("own_id"), F.md5(text.cast("binary")).alias("hash"))
    firsts = ids.groupBy("hash").agg(F.min("own_id").alias("first_id"))
    classes = sets.select("hash", "id", F.col("n").alias("n_shingles")).join(firsts, "hash").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = classes.groupBy("root").agg(F.min("first_id").alias("component"))
    return stage(classes.join(least, "root").select(F.col("hash").alias("_hash"), F.col("n_shingles").alias("_shingles"), F.col("component").alias("_component"), F.when(F.col("n_shingles") > 0, F.col("root")).alias("_class")), "classes")


def similar_classes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``docs`` with n_shingles, component_id and class_id.

    component_id is the smallest doc_id that links reach, the own included. class_id, any number, is that of the class
    itself, and null for texts without words: rows of one id may be of different classes.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks, parts = spread(spark, held, BLOCK_BYTES), spread(spark, held // 12, PART_TOKENS)
    with passing(spark):
        classes = _classes(docs, text, blocks, parts, size)
    kept = [c for c in docs.columns if c not in ("n_shingles", "component_id", "class_id")]
    joined = docs.select(*kept, F.md5(text.cast("binary")).alias("_row_hash")).join(classes, F.col("_row_hash") == F.col("_hash"))
    return joined.select(*kept, F.col("_shingles").alias("n_shingles"), F.when(F.col("_shingles") == 0, F.col("doc_id")).otherwise(F.col("_component")).alias("component_id"), F.col("_class").alias("class_id"))
