import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import lexical_search

from .conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    whole, size = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    rows = []
    for i, ts in asked.items():
        scored = []
        for d, b in bags:
            m = 50 + (50 * b.total() * whole) // size
            score = sum(math.floor(1000 * math.log((2 * whole + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in ts if b[t])
            if score > 0:
                scored.append((-score, d is not None, d or 0, d))
        rows += [(i, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k])]
    return Counter(rows)


@pytest.fixture(scope="module")
def items():
    pick = random.Random(5)
    rows = [(i, prose(i, pick.randint(1, 25))) for i in range(12)]
    return rows + [(20, "one TWO"), (21, None), (22, ""), (23, "@@ !!"), (24, "zzzunknown"), (25, prose(1, 4)), (25, prose(2, 4)), (26, "日本語 naïve’s 3½ Ñandú"), (None, prose(3, 6)), (20, "one TWO")]


@pytest.mark.parametrize("k", [1, 5, 50])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, docs, rows, items, monkeypatch, k, small):
    if small:  # several trees in a task, several batches of items, pieces of texts, a large seed
        for name, value in (("SEGMENT", 300), ("ITEM_TERMS", 60), ("PIECE", 10), ("SEED", 2), ("FAN", 3), ("SALTS", 3)):
            monkeypatch.setattr(lexical_search, name, value)
    # documents that are equal, so that scores tie across tasks
    copies = [(1000 - i, prose(i % 7, 30)) for i in range(60)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies, DOCS).repartition(4)).withColumns({c: F.lit(c) for c in ("n", "terms", "score", "item", "rank")})
    asked = spark.createDataFrame(items, ITEMS).withColumn("term", F.lit("x"))
    found = Counter(tuple(r) for r in lexical_search.rank(frame, asked, k).select("item_id", "rank", "doc_id", "score").collect())
    assert found == brute([r[:2] for r in rows] + copies, items, k)


def test_empty_tables(spark, docs, empty, items):
    asked = spark.createDataFrame(items, ITEMS)
    assert lexical_search.rank(docs, spark.createDataFrame([], ITEMS), 5).count() == 0
    assert lexical_search.rank(docs, spark.createDataFrame([(1, "!!")], ITEMS), 5).count() == 0
    assert lexical_search.rank(empty, asked, 5).count() == 0


def test_prunes_and_opens_equal_bounds():
    """A tree opens few ranges where one document stands out, and all of them where all are equal."""
    docs = 4096
    doc, term = np.arange(docs, dtype=np.int32), np.zeros(docs, np.int32)
    impact = np.arange(docs, dtype=np.int64) + 1
    best = []
    opened = lexical_search.Tree(doc, term, impact, docs, 1).search(np.array([3]), list(range(docs)), best, 5, 1)
    assert opened < 10 and sorted(best)[0] == (3 * (docs - 4), False, -(docs - 5))
    best = []
    lexical_search.Tree(doc, term, np.full(docs, 7), docs, 1).search(np.array([1]), list(range(docs))[::-1], best, 3, 1)
    assert sorted(best) == [(7, False, -2), (7, False, -1), (7, False, 0)]


def test_terms_of_items_and_documents_agree(spark, rows):
    texts = [r[1] for r in rows] + ["A-b_c\x7fÀ 9z\x00y"]
    found = spark.createDataFrame([(t,) for t in texts], "text string").select(F.sort_array(lexical_search.terms(F.col("text"))).alias("t")).collect()
    assert Counter(tuple(r["t"]) for r in found) == Counter(tuple(sorted(t.decode() for t in lexical_search.term_counts((x or "").encode()).elements())) for x in texts)
