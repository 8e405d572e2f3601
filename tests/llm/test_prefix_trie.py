import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    found = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    return found


def brute(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    rows = Counter()
    for path, cs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = {p for p in below if len(p) == len(path) + 1}
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(path))))
        rows[(min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())] += 1
    return rows


def conversations(seed, n):
    """Conversations of few different turns, so that many share prefixes, are equal or are prefixes of others."""
    pick = random.Random(seed)
    rows = []
    for c in range(n):
        kind = pick.random()
        length = 30 if kind < 0.05 else pick.randint(1, 12)
        for t in range(length):
            rows.append((c, t, pick.choice(["user", "assistant"]) if kind > 0.8 else "user", "same" if kind < 0.3 or t < 3 else pick.choice(["a", "bé", "", "long " * 9])))
    rows += [(1000 + k, t, "user", "copy") for k in range(40) for t in range(9)]
    rows += [(2000, 2, None, None), (2000, None, "user", "first"), (None, 0, "user", "nobody"), (None, None, None, None), (2006, 1, "user", "x"), (2006, 1, "user", "x")]
    pick.shuffle(rows)
    return rows


def found(df):
    names = [c.split()[0] for c in prefix_trie.NODE.split(", ")]
    return Counter(tuple(r) for r in df.select(names).collect())


@pytest.mark.parametrize("seed, n, size", [(1, 60, 1 << 20), (2, 90, 300), (3, 25, 1)])
def test_against_brute_force(spark, seed, n, size):
    rows = conversations(seed, n)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in ("block", "turns", "seq", "key", "size", "depth", "parent")})
    assert found(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(frame)), size)) == brute(rebuilt(rows))


def test_empty_and_alone(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(empty))).count() == 0
    # a single conversation that is rebuilt from nothing
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert rebuilt(rows)[c] == []
    assert found(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA))))) == brute({c: []})


def test_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    rows = [(c, 0, "user", "t") for c in range(-60, 300, 5)]
    assert found(prefix_trie.trie(prefix_trie.turns(spark.createDataFrame(rows, SCHEMA)))) == brute({c: [("user", "t")] for c, *_ in rows})


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 500, 3000])
def test_nearest_smaller_values(n):
    rng = np.random.default_rng(n)
    for values in (rng.integers(0, 6, n), rng.integers(0, 1000, n), np.arange(n), np.arange(n)[::-1].copy(), np.zeros(n, np.int64)):
        stack, want = [], []
        for i, v in enumerate(values.tolist()):
            while stack and values[stack[-1]] >= v:
                stack.pop()
            want.append(stack[-1] if stack else -1)
            stack.append(i)
        assert prefix_trie.smaller_before(values).tolist() == want
        mirrored = prefix_trie.smaller_before(values[::-1])
        assert prefix_trie.smaller_after(values).tolist() == [n - 1 - x for x in mirrored[::-1].tolist()]
        if n:
            first = rng.integers(0, n, 50)
            last = np.array([rng.integers(a + 1, n + 1) for a in first])
            assert prefix_trie.Minima(values).of(first, last).tolist() == [values[a:b].min() for a, b in zip(first, last)]
