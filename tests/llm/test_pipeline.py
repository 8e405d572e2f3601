from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import language_id, mixing

from .conftest import prose
from .test_joins import brute, removed

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def table(docs):
    return docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_against_brute_force(spark, table, tmp_path):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "suffix-array dedup", "mixing sources", "best-fit packing"]

    def written(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    first = written(stages["language ID"](spark, table, ""), "first")
    assert first.columns == COLUMNS
    kept = counted(first)
    assert not kept - counted(table)
    assert all(language_id.has_letter((t or "").encode()) for _, t, *_ in kept)
    with_letters = [r for r in table.collect() if language_id.has_letter((r["text"] or "").encode())]
    assert sum(kept.values()) >= 0.95 * len(with_letters)

    second = written(stages["n-gram Jaccard join"](spark, first, ""), "second")
    rows = [tuple(r) for r in first.collect()]
    want = Counter()
    for r, (n, component) in zip(rows, brute(rows)):
        if r[0] is None or n == 0 or r[0] == component:
            want[r] = want[r] + 1 if r[0] is None or n == 0 else 1
    assert second.columns == COLUMNS and counted(second) == want

    third = written(stages["suffix-array dedup"](spark, second, ""), "third")
    rows = [tuple(r) for r in second.collect()]
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for r, t, gone in zip(rows, texts, removed(texts)):
        text = np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") if gone.any() else r[1]
        want[(r[0], text, r[2], r[3], len(text) if gone.any() else r[4])] += 1
    assert third.columns == COLUMNS and counted(third) == want

    fourth = written(stages["mixing sources"](spark, third, ""), "fourth")
    want = Counter()
    for r in mixing.mix(third).collect():
        if r["copies"]:
            want[tuple(r[c] for c in COLUMNS)] += r["copies"]
    assert fourth.columns == COLUMNS and counted(fourth) == want

    fifth = stages["best-fit packing"](spark, fourth, "").collect()
    ends = {}
    for r in sorted(fifth, key=lambda r: (r["sequence_id"], r["offset"])):
        assert ends.get(r["sequence_id"], 0) == r["offset"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and sum(r["piece"] == 0 for r in fifth) == fourth.count()

    table.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, whole)) == Counter(map(key, fifth))


def test_unlike_documents_of_one_id_stay(spark):
    rows = [(5, prose(1, 40)), (5, prose(2, 40)), (5, prose(2, 40)), (6, prose(3, 40)), (7, prose(1, 40)), (8, None), (None, prose(4, 9))]
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, class_id string")
    found = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, "")
    assert found.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in found.collect()) == Counter([rows[i] for i in (0, 1, 3, 5, 6)])


def test_values_of_other_columns_stay(spark):
    """Columns named like those of the operators keep their values through all stages but the last."""
    names = ["class_id", "score", "n_shingles", "component_id", "lang_pred", "accepted", "n_bytes", "kept", "removed", "size", "target", "taken", "copies", "_class", "_none", "hash", "row", "block", "a.b"]
    rows = [(i, prose(i % 5, 40), "en", f"s{i % 2}", None) for i in range(12)] + [(50, None, "en", "s0", None), (None, prose(3, 40), "en", "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.concat_ws("/", F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names))
    for name, function in corpus_pipeline.STAGES[:-1]:
        found = function(spark, docs, "")
        assert found.columns == docs.columns and found.dtypes == docs.dtypes, name
        kept = found.collect()
        assert kept and all(r[n] == f"{n}/{'none' if r['doc_id'] is None else r['doc_id']}" for r in kept for n in names), name


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "sf")).count() == 0
