import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import ngram_join, suffix_dedup
from textmill.llm.bytehash import Joined

from .conftest import SCHEMA, prose

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """(n_shingles, component) of each row by its position."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)].append(r[0])
    return [(len(s), min(least[root(i)], default=None) if s else rows[i][0]) for i, s in enumerate(sets)]


def same(found, rows):
    want = Counter((r[0], n, c) for r, (n, c) in zip(rows, brute(rows)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == want


def test_classes_against_brute_force(docs, rows, empty):
    same(ngram_join.similar_classes(docs).select("doc_id", "n_shingles", "component_id").collect(), rows)
    assert ngram_join.similar_classes(empty).count() == 0


def family(n, seed):
    """Near copies of one text, some of them near only to each other."""
    pick = random.Random(seed)
    base = prose(seed, 90).split()
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(pick.randint(0, 5)):
            words[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words), "en", "s0"))
    return rows


@pytest.mark.parametrize("rounds", [0, 2])
def test_split_groups(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "SHARD", 7)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rows = family(60, 4) + family(30, 5)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    same(ngram_join.similar_classes(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


@pytest.mark.parametrize(("shard", "rows", "ids"), [(2000, 1, 120), (50, 9, 360)])
def test_texts_of_common_tokens_meet_as_lists(monkeypatch, shard, rows, ids):
    """Thirty tokens that the same 120 texts hold: one list, and not 120 x 119 / 2 pairs; more than a shard is cut."""
    monkeypatch.setattr(ngram_join, "SHARD", shard)
    t, of = np.repeat(np.arange(30, dtype=np.uint64), 120), np.tile(np.arange(120, dtype=np.int64), 30)
    each = {"tokens": t, "ids": of, "cells": of, "classes": of, "sizes": np.full(len(of), 40, np.uint32), "shared": np.full(len(of), 38, np.uint32)}
    found = ngram_join._meetings(pa.table({c: pa.array([x.tobytes()]) for c, x in each.items()}))
    lists = found.column("ids").to_pylist()
    together = set()
    for home in set(found.column("home").to_pylist()):
        held = [x for h, x in zip(found.column("home").to_pylist(), lists) if h == home]
        together |= {(a, b) for a in held[0] for b in held[-1]} | {(b, a) for a in held[0] for b in held[-1]}
    assert len(together) == 120 * 120
    assert (found.num_rows, sum(map(len, lists))) == (rows, ids)


def test_partners():
    rng = np.random.default_rng(3)
    n = rng.integers(5, 60, 300)
    shared = np.minimum(n, rng.integers(1, 60, 300))
    fits = (100 + ngram_join.PERCENT) * np.minimum(shared[:, None], shared) >= ngram_join.PERCENT * (n[:, None] + n)
    assert ngram_join._partnered(n, shared).tolist() == fits.any(axis=1).tolist()


@pytest.mark.parametrize("rounds", [0, 2])
def test_passage_in_many_texts(spark, monkeypatch, rounds):
    """Texts that share most of their tokens, mostly too few for a link, and their near copies."""
    monkeypatch.setattr(ngram_join, "SHARD", 7)
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    passage = prose(11, 40)
    texts = [prose(500 + i, 6 + i % 5) + " " + passage + " " + prose(700 + i, 5 + i % 4) for i in range(40)]
    texts += [t + " end" for t in texts[:9]]
    rows = [(i, t, "en", "s0") for i, t in enumerate(texts)]
    same(ngram_join.similar_classes(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_only_wanted_texts_are_dealt(spark):
    texts = spark.createDataFrame([(i, prose(i, 30), "en", "s0") for i in range(400)], SCHEMA)
    wanted = texts.where("doc_id % 20 = 0").select(F.md5(F.col("text").cast("binary")).alias("hash"))
    found = {r["hash"] for r in ngram_join._different(texts, F.col("text"), 4, wanted).select("hash").collect()}
    assert found >= {r["hash"] for r in wanted.collect()} and len(found) < 100


def test_links_of_connects_what_brute_force_connects():
    rng = np.random.default_rng(0)
    sets = [np.sort(rng.choice(60, size=rng.integers(20, 40), replace=False)).astype(np.uint64) for _ in range(80)]
    roles = [ngram_join.MEMBER] * 60 + [ngram_join.VISITOR] * 20
    names = [f"{i:03d}" for i in range(80)]
    near = lambda a, b: 100 * len(set(a) & set(b)) >= 75 * len(set(a) | set(b))

    def classes(edges):
        parent = {n: n for n in names}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return sorted(sorted(n for n in names if root(n) == r) for r in {root(n) for n in names})

    whole = [(names[i], names[j]) for i in range(80) for j in range(60) if i != j and near(sets[i].tolist(), sets[j].tolist())]
    assert classes(ngram_join.links_of(sets, roles, names)) == classes(whole)
    known = [(names[i], names[j]) for i in range(0, 30) for j in range(i) if near(sets[i].tolist(), sets[j].tolist())]
    of = {n: c[0] for c in classes(known) for n in c}
    assert classes(known + ngram_join.links_of(sets, roles, names, [of[n] for n in names], within=True)) == classes(whole)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(f"{i:04d}", f"{i + 1:04d}") for i in range(70)] + [("a", "b")], "a string, b string")
    roots = {r["node"]: r["root"] for r in ngram_join.components(links).collect()}
    assert set(roots.values()) == {"0000", "a"} and len(roots) == 73


def removed(texts):
    """Bytes that go, by position, from the definition."""
    where = Counter()
    for t in texts:
        for i in range(len(t) - 199):
            where[t[i : i + 200]] += 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if where[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append(gone)
    return out


def test_removal_against_brute_force(docs, rows, empty):
    found = suffix_dedup.remove_repeats(docs)
    assert set(docs.columns) <= set(found.columns)
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, removed(texts)):
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[(r[0], len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())] += 1
    got = Counter((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["removed"]), len(r["removed"]), hashlib.sha256(r["kept"]).hexdigest()) for r in found.collect())
    assert got == want
    assert suffix_dedup.remove_repeats(empty).count() == 0
    whole = suffix_dedup.remove_repeats(docs, whole_characters=True).select(F.is_valid_utf8(F.col("kept").cast("string")).alias("ok"))
    assert whole.where("not ok").count() == 0


def two_sided(seed):
    """A text none of whose strings of 200 bytes repeats, and two others that repeat what lies to the left of one of its anchors and to the right."""
    rng = np.random.default_rng(seed)
    noise = lambda n: rng.integers(97, 123, n, np.uint8).tobytes()
    text = noise(700)
    anchors = suffix_dedup.Anchors([text])
    hashes = anchors.joined.windows(64)
    p = min((a for a in anchors.at.tolist() if 200 <= a <= 400), key=lambda a: hashes[a] >> np.uint64(32))
    return [text, noise(150) + text[p - 68 : p + 64] + noise(150), noise(150) + text[p : p + 132] + noise(150)]


def test_an_anchor_is_no_repeat_of_itself(spark):
    texts = [t.decode() for seed in range(12) for t in two_sided(seed)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, "en", "s0") for i, t in enumerate(texts)], SCHEMA))
    assert [r["doc_id"] for r in found.where("size(removed) > 0").collect()] == []
    assert not any(g.any() for g in removed([t.encode() for t in texts]))


def test_merge_of_front_coded_runs():
    pick = random.Random(1)
    runs = [sorted("".join(pick.choices("ab", k=pick.randint(0, 9))).encode() for _ in range(pick.randint(0, 40))) for _ in range(7)]
    merged = list(suffix_dedup.merge_runs([suffix_dedup.front_decode(suffix_dedup.front_code(r)) for r in runs]))
    entries = [e for _, e, _ in merged]
    assert entries == sorted(x for r in runs for x in r)
    for (_, a, _), (_, b, shared) in zip(merged, merged[1:]):
        assert shared == suffix_dedup.common(a, b, 0)


def test_anchors_repeat_with_their_string():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 200, np.uint8).tobytes()
    texts = [rng.integers(97, 123, n, np.uint8).tobytes() + passage + rng.integers(97, 123, m, np.uint8).tobytes() for n, m in ((0, 900), (333, 0), (801, 77))]
    found = suffix_dedup.Anchors(texts)
    inside = [set((found.at[found.text == t] - found.joined.starts[t] - n).tolist()) for t, n in enumerate((0, 333, 801))]
    assert set.intersection(*({x for x in s if 0 <= x <= 136} for s in inside))


@pytest.mark.parametrize("texts", [[b"a b", b"", b"  x"], [b"one"], [b""]])
def test_words_of_joined_texts(texts):
    hashes, counts = Joined(texts, True).words()
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == counts.sum()
