import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import language_id, ppm, quality_rules

from .conftest import SCHEMA, crc

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
SYLLABLES = {"xa": ["tion", "the", "ing", "er", "wh"], "xb": ["keit", "ung", "sch", "ü", "der"], "xc": ["ção", "lh", "ã", "que", "do"]}


def speak(lang, seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(n))


def test_language_accuracy_on_held_out_documents(spark):
    rows = [(i, speak(lang, i, 5 + i % 40), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 80)]
    rows += [(900, None, "xa", "s"), (901, "123 456 !!", "xb", "s"), (902, "", None, "s")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("accepted", F.lit("clash"))
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = language_id.train(*language_id.sample(docs, "lang", fold != 1))
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    held = [r for r in rows if crc(r[0], 3) == 1 and r[0] < 900]
    assert np.mean([found[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 and not found[i]["accepted"] for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert sum(not r["accepted"] for r in found.values()) < 10


def test_language_without_training_rows(spark, empty):
    model = language_id.train(*language_id.sample(empty, "lang", F.lit(True)))
    assert model is None and language_id.predict(empty, model).count() == 0
    one = spark.createDataFrame([(1, "text", None, None)], SCHEMA)
    assert language_id.predict(one, model).first()["lang_pred"] == "und"


def test_quality_accuracy_and_compiled_rules(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 3 != 0
        text = speak("xa", i, 30 + i % 50)
        rows.append((i, text if good else text.upper().replace(" ", "!! ") if rng.random() < 0.5 else text.replace(" ", "$$$ "), "en", "s"))
        labels.append((i, int(good), 0))
    rows.append((1000, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = quality_rules.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "quality", fold != 2)
    found = {r["doc_id"]: r for r in quality_rules.score(docs, model).collect()}
    held = [i for i in range(600) if crc(i, 4) == 2]
    assert np.mean([found[i]["predicted"] == labels[i][1] for i in held]) > 0.95
    x = np.array([quality_rules.statistics_of((r[1] or "").encode()) for r in rows])
    assert np.allclose(model.scores(x), [found[r[0]]["score"] for r in rows])
    assert 0 < len(model.rules) and 0 <= found[1000]["score"] <= 1


def test_quality_without_labels(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality_rules.fit(empty, none, "quality", F.lit(True))
    assert quality_rules.score(spark.createDataFrame([(1, "t", None, None)], SCHEMA), model).first()["score"] == 0.5
    assert quality_rules.score(empty, model).count() == 0


class Plain:
    """Prediction by partial matching as a dictionary of counters."""

    def __init__(self, texts):
        self.next = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
        for t in texts:
            s = [0] * ppm.ORDER + [b + 1 for b in t] + [0]
            for i in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    self.next[k][tuple(s[i - k : i])][s[i]] += 1

    def p(self, context, symbol):
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            seen = self.next[k].get(tuple(context[len(context) - k :]))
            if not seen:
                continue
            open_ = {a: n for a, n in seen.items() if a not in excluded}
            if open_:
                whole = sum(open_.values()) + len(open_)
                if symbol in open_:
                    return p * open_[symbol] / whole
                p *= len(open_) / whole
            excluded = set(seen)
        return p / (ppm.SYMBOLS - len(excluded))

    def log10(self, text):
        s = [0] * ppm.ORDER + [b + 1 for b in text] + [0]
        return sum(math.log10(self.p(s[i - ppm.ORDER : i], s[i])) for i in range(ppm.ORDER, len(s)))


@pytest.mark.parametrize("block_bytes, fan", [(ppm.BLOCK_BYTES, ppm.FAN), (6000, 2)])
def test_ppm_against_plain_model(docs, rows, empty, monkeypatch, block_bytes, fan):
    monkeypatch.setattr(ppm, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(ppm, "FAN", fan)
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 1, F.lit(True))
    found = ppm.score(docs, train).collect()
    texts = [(r[1] or "").encode().translate(LOWER) for r in rows]
    trains = [r[0] is None or crc(r[0], 5) != 1 for r in rows]
    tokens = [re.findall(rb"[^\x20\x09-\x0D]+", t) + [None] for t in texts]
    counts = Counter(w for ws, x in zip(tokens, trains) if x for w in ws)
    n, v = sum(counts.values()), len(counts)
    model = Plain([t for t, x in zip(texts, trains) if x])
    want = {}
    for r, t, ws, x in zip(rows, texts, tokens, trains):
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want[(r[0], len(ws))] = (not x, sum(counts[w] > 0 for w in ws), n, base, model.log10(t) if len(t) < 6000 else None)
    assert len(found) == len(rows)
    for r in found:
        held, known, total, base, score = want[(r["doc_id"], r["n_tokens"])]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (held, known, total) and r["base_score"] == pytest.approx(base)
        assert score is None or r["score"] == pytest.approx(score)
    assert ppm.score(empty, F.lit(True)).count() == 0


def test_ppm_probabilities_sum_to_one():
    texts = [b"abracadabra", b"banana bandana", b"cabana"]
    keys, counts = ppm._merge([ppm._counted(*(lambda c: (c, np.ones(len(c), np.uint64)))(ppm.codes(texts)[0]))])
    pairs = np.zeros((ppm.SYMBOLS, ppm.SYMBOLS))
    np.add.at(pairs, ((keys >> np.uint64(9) & ppm._mask(1)).astype(int), (keys & ppm._mask(1)).astype(int)), counts)
    trie = ppm.Trie(keys, counts, pairs)
    for context in (b"abra", b"band", b"zzan", b"qqqq", b"ana "):
        head = 0
        for b in context:
            head = head << 9 | b + 1
        codes = np.array([head << 9 | s for s in range(ppm.SYMBOLS)], np.uint64)
        assert (10 ** trie.log10(codes)).sum() == pytest.approx(1)
