"""Answers that are JSON, hold JSON, or are broken."""

import json

import pytest
from pyspark.sql import functions as F

from textmill.functions import answers

GOOD = {"confirmed_information": {"quem": " A  b ", "what": "x", "nothing": "z", "where": ""}, "missing_fields": ["quando", "when", "why", 3, "else"], "suggested_questions": ["One?", {"question": "Two?"}, {"text": "Three?"}, {}, ""], "claims": ["c1", " "], "briefing": " the  text "}
CASES = {
    "good": (json.dumps(GOOD), None, False, {"who": "A b", "what": "x"}, ["when", "why"], ["One?", "Two?", "Three?"], ["c1"], "the text"),
    "recovered": ('Sure: {"claims": ["a } b", "q\\"{"], "briefing": "t"} and {"more": 1}', None, True, {}, [], [], ["a } b", 'q"{'], "t"),
    "kinds": ('{"confirmed_information": [1], "confirmed_fields": {"link": "u"}, "missing_information": "who", "questions": 5, "claims": {}}', None, False, {"source": "u"}, [], [], [], None),
    "broken": ('{"claims": ["a"', "no_json", False, {}, [], [], [], '{"claims": ["a"'),
    "plain": ("not json", "no_json", False, {}, [], [], [], "not json"),
    "list": ("[1, 2]", "not_an_object", False, {}, [], [], [], "[1, 2]"),
    "other": ('{"answer": 1}', "no_known_key", False, {}, [], [], [], '{"answer": 1}'),
    "empty": ("", "no_json", False, {}, [], [], [], ""),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()] + [("null", None)], "k string, t string")
    return {r["k"]: r["a"] for r in rows.select("k", answers.parse_answer(F.col("t")).alias("a")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_values_and_reasons(parsed, name):
    _, reason, recovered, confirmed, missing, questions, claims, briefing = CASES[name]
    a = parsed[name]
    assert (a["reason"], a["recovered"], a["confirmed"], a["missing"], a["questions"], a["claims"]) == (reason, recovered, confirmed, missing, questions, claims)
    assert briefing is None or a["briefing"] == briefing


def test_null_is_no_json(parsed):
    assert parsed["null"]["reason"] == "no_json"
