import random
import re

import xxhash
from pyspark.sql import functions as F

from textmill.llm import order_minhash

from .conftest import prose

TOP = 1 << order_minhash.BITS


def chained(*values):
    """The 64-bit hash of several values: each is hashed with the hash so far as its seed."""
    h = 42
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else v, seed=h).intdigest()
    return h


def signed(h, size=8):
    return (h % (1 << 8 * size)).to_bytes(size, "little")


def brute(text):
    """Signature by taking, for each mark, the two elements that follow on the circle of hashes."""
    words = []
    for w in re.split(r"[\x20\x09-\x0D]+", text):
        words += list(w) if len(w) > order_minhash.LONG else [w]
    elements, met = {}, {}
    for i in range(max(1, len(words) - order_minhash.K + 1)):
        top = chained(*words[i : i + order_minhash.K]) // TOP
        met[top] = met.get(top, 0) + 1
        if met[top] > 1:
            signed_top = top - (1 << 40) if top >= 1 << 39 else top
            top = chained(signed(signed_top), signed(met[top] - 1, 4)) // TOP
        elements[i] = top
    as_signed = lambda top: top - (1 << 40) if top >= 1 << 39 else top
    circle = sorted((as_signed(top), i) for i, top in elements.items())
    step, out = (1 << 40) // order_minhash.SLOTS, []
    for j in range(order_minhash.SLOTS):
        mark = -(1 << 39) + j * step
        first = next((k for k, (top, i) in enumerate(circle) if (top, i) > (mark, TOP - 1)), len(circle)) % len(circle)
        pair = sorted([circle[first], circle[(first + 1) % len(circle)]], key=lambda e: e[1])
        out.append(chained(*(signed(top) for top, _ in pair)) % (1 << 16) - 32768)
    return out


def test_signatures_against_brute_force(spark):
    texts = ["", "one", "one two three", prose(3, 60), prose(4, 12) * 3, "a b a b a b a b", "tab\tline\nfeed  two", "x" * 60, "日本語の文章には空白がありません" * 3 + " end", " lead and trail "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", order_minhash.signature(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: brute(t) for i, t in enumerate(texts)}


def test_texts_without_blanks_are_sensitive_to_edits(spark):
    pick = random.Random(1)
    text = "".join(pick.choice("abcdefghijklmnop") for _ in range(2000))
    pairs = [(0, text, text[:1000] + "Z" + text[1001:]), (1, text, text[1000:] + text[:1000]), (2, text, text[::-1]), (3, prose(1, 300), prose(1, 300).replace(" ", "\n"))]
    df = spark.createDataFrame(pairs, "i long, a string, b string")
    found = {r["i"]: r["l"] for r in df.select("i", order_minhash.likeness(order_minhash.signature(F.col("a")), order_minhash.signature(F.col("b"))).alias("l")).collect()}
    assert found[0] > 0.9 and 0.2 < found[1] < 1 and found[2] < 0.1 and found[3] == 1


def test_next_documents_with_outlying_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "BUCKET_ROWS", 2)
    for ids in ([*range(300), 10**15, -(10**12)], [7] * 200 + list(range(100)), [7] * 50, [None] * 40 + [3, 2], [5]):
        rows = [(i, f"text number {k}") for k, i in enumerate(ids)]
        found = order_minhash.with_next(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "text", "next_text").collect()
        order = {t: (i is None, -(i or 0), signed_hash(t)) for i, t in rows}
        line = [t for t in sorted(order, key=order.get)]
        assert {r["text"]: r["next_text"] for r in found} == dict(zip(line, line[1:] + line[:1])) and len(found) == len(rows)


def signed_hash(text):
    h = chained(text)
    return h - (1 << 64) if h >= 1 << 63 else h
