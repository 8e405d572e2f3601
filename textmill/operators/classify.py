"""Text classification: sublinear TF-IDF over one and two words with balanced logistic regression or a linear SVM, and the same projected on singular vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.scratch import stage
from . import vectors

VOCABULARY, PROJECTED, DIMS = 50_000, 60_000, 128
MODELS = ("tfidf_logistic", "tfidf_svm", "embedding_logistic")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    weights = counts.crossJoin(whole).select(label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))  # one row
    return df.join(F.broadcast(weights), label)  # one row for each class


@F.udf(VectorUDT())
def _sparse(size, indices, values):
    return Vectors.sparse(size, indices, values)


@dataclass
class TextFeatures:
    """A fitted vocabulary, and singular vectors where texts are projected."""

    terms: vectors.TfIdf
    dense: vectors.DenseModel | None = None

    @classmethod
    def fit(cls, df: DataFrame, text: str, projected: bool, vocabulary: int | None = None) -> TextFeatures:
        if projected:
            dense = vectors.fit_dense(df, text, DIMS, vocabulary or PROJECTED)
            return cls(dense.terms, dense)
        return cls(vectors.TfIdf.fit(df, text, vocabulary or VOCABULARY))

    def transform(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``features`` in place of the text."""
        if self.dense:
            return self.dense.transform(df, text).withColumn("features", array_to_vector("embedding")).drop("embedding")
        rows = self.terms.rows(df, text)
        return rows.withColumn("features", _sparse(F.lit(len(self.terms.index)), "indices", "values")).drop("indices", "values")


def _classifier(name: str):
    if name == "tfidf_svm":
        return OneVsRest(classifier=LinearSVC(maxIter=30, regParam=1e-3), weightCol="weight")
    return LogisticRegression(weightCol="weight", maxIter=60, regParam=1e-3)


@dataclass
class Classifier:
    features: TextFeatures
    labels: list[str]
    model: object

    def predict(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with ``predicted``."""
        ready = self.features.transform(df.withColumn("_text", F.col(text)), "_text").withColumn("weight", F.lit(1.0))
        return self.model.transform(ready).select(*df.columns, self.name(F.col("prediction")).alias("predicted"))

    def name(self, prediction: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.labels)), prediction.cast("int"))


def compare(train_rows: DataFrame, test_rows: DataFrame, text: str, label: str, vocabulary: int | None = None) -> dict[str, DataFrame]:
    """(label, predicted) of the test rows by each of :data:`MODELS`. Models with the same features share them: texts are read once for what is fitted and once for what is made of it."""
    found, held = {}, {}
    for name in MODELS:
        projected = name.startswith("embedding")
        if projected not in held:
            features = TextFeatures.fit(train_rows, text, projected, vocabulary)
            labels, ready = _ready(train_rows, text, label, features, name)
            asked = stage(features.transform(test_rows.select(label, text), text).withColumn("weight", F.lit(1.0)), f"{name}-test")
            held[projected] = features, labels, ready, asked
        features, labels, ready, asked = held[projected]
        classifier = Classifier(features, labels, _classifier(name).fit(ready))
        predicted = classifier.model.transform(asked.withColumnRenamed(label, "_label")).select(F.col("_label").alias(label), classifier.name(F.col("prediction")).alias("predicted"))
        found[name] = stage(predicted, name)
    return found


def _ready(df: DataFrame, text: str, label: str, features: TextFeatures, name: str) -> tuple[list[str], DataFrame]:
    """The labels in order, and (label, weight, features) of the rows."""
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # one row for each class
    numbered = balanced(df.select(label, text), label).withColumn("label", (F.array_position(F.array(*map(F.lit, labels)), F.col(label)) - 1).cast("double"))
    return labels, stage(features.transform(numbered, text).select("label", "weight", "features"), f"{name}-train")


def train(df: DataFrame, text: str, label: str, name: str, vocabulary: int | None = None, features: TextFeatures | None = None) -> Classifier:
    """The model ``name`` fitted to the rows; ``features`` that are fitted already are used as they are."""
    features = features or TextFeatures.fit(df, text, name.startswith("embedding"), vocabulary)
    labels, ready = _ready(df, text, label, features, name)
    return Classifier(features, labels, _classifier(name).fit(ready))
