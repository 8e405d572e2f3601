"""Strict briefings: worked cases by hand, and cases without anything."""

import pytest
from pyspark.sql import functions as F

from textmill.operators import strict

CASES = "case_id string, pitch string, predicted_type string, source_type string, source_unit string, expected map<string,string>"
PASSAGES = "case_id string, rank int, title string, type string, unit string"


def row(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_questions_stand_for_fields(spark):
    assert row(spark, strict.inferred(F.lit("Qual é o prazo de inscrição e onde está o edital?"))) == ["when", "where", "source", "how"]
    asked = row(spark, strict.asked(F.lit("research"), F.array(F.lit("when"))))
    assert [q["field"] for q in asked] == ["when", "who+why"]
    assert [q["field"] for q in row(spark, strict.asked(F.lit("event"), F.array().cast("array<string>")))] == ["when+where", "how"]
    score = lambda field, question, missing, present: row(spark, strict.question_score(F.struct(F.lit(field).alias("field"), F.lit(question).alias("question")), F.array(*map(F.lit, missing)), F.array(*map(F.lit, present))))
    assert score("when", "Qual data?", ["when"], ["what"]) == 1.0
    assert score("when", "Qual data?", ["when"], ["when"]) == 0.0
    assert score("type_specific", "Mais?", ["when"], ["what"]) == 0.25
    assert score("who", "Mais?", ["when"], ["what"]) == 0.0


def test_missing_fields_by_tokens(spark):
    expected = {"what": "never", "who": "Maria Silva", "where": "campus of the far north", "source": "--", "when": "", "unit": None}
    df = spark.createDataFrame([(expected,)], "expected map<string,string>")
    found = df.select(strict.actual_missing(F.col("expected"), F.lit("Maria Silva, of the campus")).alias("m")).first()["m"]
    # three tokens of five are enough; a value without tokens is never there
    assert found == ["source"]


@pytest.fixture(scope="module")
def scored(spark):
    expected = {"what": "Open day of the laboratory", "who": "Maria Silva", "when": "2024-05-01", "where": "", "why": "The laboratory opens doors", "how": "", "source": "art_1", "unit": "North"}
    cases = [
        ("a", "The laboratory opens doors", "event", "event", "North", expected),
        ("b", "The laboratory opens doors", "other", "event", None, expected),
        ("empty", None, None, None, None, {}),
    ]
    # the unit of the source comes sixth only: ranks have no gaps, and the first five count
    others = [("a", i, f"Far away {i}", "event", "South") for i in range(2, 6)]
    passages = [("a", 6, "Sixth", "event", "North"), *others, ("a", 1, "Zebra crossing reopened", "event", "South"), ("b", 1, "Quiet harvest season", "research", "North"), ("a", 11, "Beyond", "event", "North")]
    written = strict.outputs(spark.createDataFrame(cases, CASES), spark.createDataFrame(passages, PASSAGES))
    return {(r["case_id"], r["configuration"]): r for r in strict.scores(written).collect()}, written


def test_scores_of_a_case(scored):
    found, written = scored
    r = found["a", strict.REPORTER]
    # what and why of six known values; when, who, source and unit are missing and all are detected
    assert (r["completeness"], r["structure"], r["missing_detected"]) == (round(2 / 6, 4), 1.0, 1.0)
    assert (r["n_questions"], r["same_type5"], r["same_unit5"]) == (6, 1, 0)
    assert found["b", strict.REPORTER]["same_unit5"] is None
    assert found["a", strict.FIXED]["structure"] == 0.0 and found["a", strict.FIXED]["n_questions"] == 0
    assert found["a", strict.DIRECT]["missing_detected"] == 0.5
    text = written.where("case_id = 'a' and configuration = 'virtual_reporter'").first()["briefing"]
    assert text.splitlines()[3] == "missing_information: ['who', 'when', 'source', 'unit']"
    assert "similar_news: ['Zebra crossing reopened', 'Far away 2', 'Far away 3']" in text


def test_claims_see_their_own_passages_only(spark, scored):
    """The titles that one case found support no claim of another, nor of a configuration that did not search."""
    found, written = scored
    lines = F.lit("Zebra crossing reopened")
    changed = written.withColumn("briefing", lines)
    got = {(r["case_id"], r["configuration"]): r["precision"] for r in strict.scores(changed).collect()}
    assert got["a", strict.REPORTER] == 1.0
    assert {v for k, v in got.items() if k != ("a", strict.REPORTER)} == {0.0}


def test_case_without_anything(scored):
    found, _ = scored
    for name in (strict.FIXED, strict.DIRECT, strict.REPORTER):
        r = found["empty", name]
        assert r["completeness"] == 0.0 and r["same_type5"] == 0 and r["same_unit5"] is None and r["missing_detected"] == 0.0


def test_means_and_empty_tables(spark, scored):
    _, written = scored
    means = {r["configuration"]: r for r in strict.aggregate(strict.scores(written)).collect()}
    assert means[strict.REPORTER]["cases"] == 3 and means[strict.REPORTER]["same_unit5"] == 0.0
    none = strict.outputs(spark.createDataFrame([], CASES), spark.createDataFrame([], PASSAGES))
    assert strict.aggregate(strict.scores(none)).count() == 0
