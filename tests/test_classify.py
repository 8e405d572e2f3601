"""The three classifiers on the smallest tables."""

import os

from textmill.operators import classify
from textmill.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_three_models_are_compared(spark):
    rows = catalogue.queries()["c11_train"](spark, SF).collect()
    assert sorted(r["model"] for r in rows) == ["embedding_logistic", "tfidf_logistic", "tfidf_svm"]
    assert all(r["accuracy"] > 0.5 for r in rows)


def test_models_with_the_same_features_share_their_rows(spark, monkeypatch):
    """Two sets of features, each made once of the training texts and once of the others."""
    made = []
    transform = classify.TextFeatures.transform
    monkeypatch.setattr(classify.TextFeatures, "transform", lambda self, *args: made.append(1) or transform(self, *args))
    words = {"de": "der die das und", "en": "the of and to", "es": "el la de que"}
    rows = spark.createDataFrame([(lang, f"{said} w{i % 4} x{i % 3}") for lang, said in words.items() for i in range(8)], "lang string, text string")
    found = classify.compare(rows, rows, "text", "lang", 40)
    assert len(made) == 4
    assert all(sorted(map(tuple, df.collect())) == sorted((lang, lang) for lang in words for _ in range(8)) for df in found.values())
