import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from textmill.llm import mixing, order_minhash, packing, url_filter
from textmill.llm.queries import URL_RULES, op8_url_filter, tokenizer_path


def test_packing_against_the_tokenizer(docs, rows, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    found = packing.pack(docs, tokenizer_path(), 512).collect()
    want = Counter()
    for r in rows:
        ids = np.array(exact.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            want[(r[0], k, a, len(ids[a : a + 512]), zlib.crc32(ids[a : a + 512].tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack(empty, tokenizer_path()).count() == 0


def fewest(lengths, capacity):
    """Exact number of bins by search, for small instances."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for room in {b for b in bins if b >= lengths[i]}:
            rest = list(bins)
            rest.remove(room)
            place(i + 1, [*rest, room - lengths[i]])
        place(i + 1, [*bins, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=0, max_size=9))
def test_reduction_stays_near_the_fewest(lengths):
    groups = packing.reduce_and_pack(Counter(lengths), 20)
    assert Counter(x for g, n in groups for x in g * n) == Counter(lengths)
    assert all(sum(g) <= 20 and n > 0 for g, n in groups)
    assert sum(n for _, n in groups) <= fewest(lengths, 20) + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(3, 25), min_size=0, max_size=9), st.integers(20, 30))
def test_fixed_sets_are_part_of_an_optimum(lengths, capacity):
    lengths = [n for n in lengths if n <= capacity]
    groups, left = packing.reduce_lengths(Counter(lengths), capacity)
    assert Counter(x for g, n in groups for x in g * n) + Counter(left) == Counter(lengths)
    assert sum(n for _, n in groups) + fewest(list(Counter(left).elements()), capacity) == fewest(lengths, capacity)


def test_sets_are_judged_against_all_that_is_not_fixed():
    lengths = [9, 9, 10, 10, 14, 19, 25, 25]
    groups, left = packing.reduce_lengths(Counter(lengths), 50)
    assert sum(n for _, n in groups) + fewest(list(Counter(left).elements()), 50) == fewest(lengths, 50) == 3


def test_slots_hold_each_rank_once():
    plan = packing.slots([((5, 5, 2), 3), ((7, 2), 4)])
    assert sorted(map(tuple, plan.tolist())) == [(2, 0, 0, 10), (2, 3, 3, 7), (5, 0, 0, 0), (5, 3, 0, 5), (7, 0, 3, 0)]


def test_mix_targets_and_bounds(docs, rows, empty):
    mixed = mixing.mix(docs.drop("size"))
    found = mixed.collect()
    assert len(found) == len(rows) and set(docs.columns) <= set(mixed.columns)
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert r["size"] == len((r["text"] or "").replace("\x1c", "x").split())
    total = sum(r["size"] for r in found)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(total)
    for rs in by.values():
        assert rs[0]["target"] <= 3 * rs[0]["source_size"] + 1e-6
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 2 * max(r["size"] for r in rs) + 1
    again = Counter((r["doc_id"], r["taken"]) for r in mixing.mix(docs.drop("size").repartition(7)).collect())
    assert again == Counter((r["doc_id"], r["taken"]) for r in found)
    assert mixing.mix(empty).count() == 0
    assert mixing.emit(mixed, docs.columns).count() == sum(r["copies"] for r in found)


def reshared(sizes, weights):
    """Targets by resharing step by step."""
    target = {s: 0.0 for s in sizes}
    left, open_ = float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        whole = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / whole for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("sizes", [[5, 100, 30, 2, 80], [1, 1, 1000], [10], [7, 0, 500, 3, 3, 3, 900]])
def test_targets_equal_stepwise_resharing(spark, sizes):
    named = {f"s{i}": n for i, n in enumerate(sizes)}
    want = reshared(named, {s: i % 3 + 1 for i, s in enumerate(named)})
    found = mixing.targets(spark.createDataFrame([*named.items()], "source string, source_size long")).collect()
    assert {r["source"]: pytest.approx(r["target"]) for r in found} == want


URLS = ["http://a.com/en/1", "https://Example.COM/en/7", "https://x.example.com/en/71?q", "http://example.com/en/8", "http://other.net/de/", "http://m.example.net/de/85", "http://example.org/es/#x", "http://com/en/", "http://notexample.com/en/7", "no scheme", "://?x", "http://examplecom/en/", "http://b.org/es", None, ""]


def test_urls_against_a_list_of_rules(spark):
    def judge(url):
        if not url or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:end].lower()
        path = rest[end:].split("?")[0].split("#")[0]
        fits = [(len(r), r, v) for v, r in URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        return host, path, *(max(fits)[1:] if fits else (None, "allow"))

    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, URL_RULES).collect()}
    assert found == {i: judge(u) for i, u in enumerate(URLS)}
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0
    assert url_filter.RuleTrie([("allow", "a.b"), ("block", "a.b")]).match("a.b", "") == ("a.b", "block")


def test_url_rules_of_the_contract(spark, tmp_path):
    pages = [(1, "http://other.net/de/1"), (2, "http://m.example.net/de/85"), (3, "http://example.net/de/7"), (4, "http://a.com/en/1"), (5, "http://example.com/en/7"), (6, "http://b.org/es/1"), (7, "http://b.org/en/1")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in op8_url_filter(spark, str(tmp_path)).collect()}
    assert found == {1: ("net/de/", "allow"), 2: ("example.net/de/8", "block"), 3: ("net/de/", "allow"), 4: ("com/en/", "block"), 5: ("example.com/en/7", "allow"), 6: ("org/es/", "block"), 7: (None, "allow")}


def test_fingerprints(spark, docs, rows, empty):
    found = order_minhash.compare_edited(docs).collect()
    assert len(found) == len(rows)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    texts = {r[0]: r[1] or "" for r in rows}
    by_text = {}
    for r in found:
        if r["doc_id"] is None or r["doc_id"] == 140:
            continue
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 4 * order_minhash.SLOTS
    for a, b in zip(order, order[1:]):
        if a[0] == 140:
            continue
        text, following = a[1] or "", b[1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert next(r for r in found if r["doc_id"] == a[0])["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    one = spark.createDataFrame([(5, "a b c d e f g h i j")], "doc_id long, text string")
    assert order_minhash.compare_edited(one).first()["near_next"] == 1
    assert order_minhash.compare_edited(empty).count() == 0


def test_likeness_follows_order_and_edits(spark):
    words = [f"w{i}" for i in range(200)]
    variants = {"same": words, "one": [*words[:100], "new", *words[101:]], "half": [*words[:100], *(f"v{i}" for i in range(100))], "moved": [*words[100:], *words[:100]], "other": [f"u{i}" for i in range(200)]}
    rows = spark.createDataFrame([(k, " ".join(v)) for k, v in variants.items()], "k string, t string").select("k", order_minhash.signature(F.col("t")).alias("s"))
    sig = {r["k"]: r["s"] for r in rows.collect()}
    near = {k: np.mean([a == b for a, b in zip(sig["same"], sig[k])]) for k in variants}
    assert near["same"] == 1 and near["one"] > 0.8 and 0.05 < near["half"] < 0.6 and near["other"] < 0.05
    assert near["moved"] < 0.75  # the same words in another order


def test_repeated_kmers_are_numbered(spark):
    rows = spark.createDataFrame([("a", "x y z " * 30), ("b", "x y z " * 60)], "k string, t string").select("k", order_minhash.signature(F.col("t")).alias("s")).collect()
    assert rows[0]["s"] != rows[1]["s"]
