"""The run of four configurations: what each sees and writes, retries, stops and resumption, calls under way."""

import json
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textmill.operators import configurations as conf
from textmill.sources.models import Busy, Calls, ask
from textmill.streaming.checkpoint import CheckpointStore
from textmill.streaming.evaluation_run import IncompleteRunError, run

ARTICLES = "case_id string, title string, lead string, body string, author string, unit string, published string, url string, how string"
PASSAGES = "case_id string, rank int, article_id string, title string, lead string, preview string"
GOOD = json.dumps({"confirmed_information": {"quem": "Ana", "what": "ignored"}, "missing_information": ["how"], "suggested_questions": ["Mais algo?"], "factual_claims": ["Zebra crossing"]})
CALLS = Calls(tasks=2, in_flight=2, pause=0.01)


def once(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def recorder(folder, answer):
    """A model that leaves a file for each call, as workers share no memory with the test."""

    def model(prompt):
        with open(f"{folder}/{time.time_ns()}-{threading.get_ident()}", "w") as f:
            f.write(prompt)
        return answer(prompt)

    return model


def asked(folder):
    return [p.read_text() for p in Path(folder).iterdir()]


@pytest.fixture
def made(spark, tmp_path):
    rows = [(f"case_000{i}", f"Title {i}", "", f"Fact {i} happens in North. More.", None, "North", "2024-05-01", "http://x.org/1", "") for i in range(1, 5)]
    cases = conf.pilot_cases(spark.createDataFrame(rows, ARTICLES)).withColumn("predicted_type", F.lit("event"))
    passages = spark.createDataFrame([("case_0001", 1, "a1", "Zebra crossing", "Lead of it", "Body"), ("case_0001", 6, "a6", "Too far", "", "")], PASSAGES)
    calls = tmp_path / "calls"
    calls.mkdir()
    return cases, passages, calls, lambda **more: CheckpointStore.create_or_open(spark, f"file://{tmp_path}/store", {"seed": 1} | more)


def test_cases_hide_what_is_secret(made):
    case = made[0].orderBy("case_id").first()
    assert "North" not in case["pitch"] and "Fato informado: Title 1." in case["pitch"] and "Contexto informado: Fact 1 happens in [FIELD REMOVED]." in case["pitch"]
    assert case["removed_fields"] == ["who", "when", "where", "source", "unit"] and case["ground_truth"]["who"] == "North"


def test_labelled_values_and_cues(spark):
    pitch = F.lit("Fato informado: Projeto X. Data confirmada: 2026-01-02. Ha informacoes ainda pendentes de confirmacao.")
    found = once(spark, conf.extract(pitch))
    assert found == {"what": "Projeto X", "when": "2026-01-02"}
    # a date is named, so it is asked for although there is one
    assert once(spark, conf.missing(pitch, conf.extract(pitch))) == ["who", "when", "where", "why", "how", "source", "unit"]
    assert once(spark, conf.extract(F.lit("see http://a.b/c), on 1/2/2024"))) == {"when": "1/2/2024", "source": "http://a.b/c"}


def test_questions_cover_each_field_once(spark):
    asked_ = once(spark, conf.adaptive(F.lit("event"), F.array(F.lit("when"), F.lit("how"), F.lit("unit"))))
    assert [q["field"] for q in asked_] == ["when", "how", "unit"]
    assert once(spark, conf.adaptive(F.lit("none"), F.array().cast("array<string>"))) == []


def test_all_four_outputs(spark, made):
    cases, passages, folder, store = made
    found = {r["case_id"]: json.loads(r["record"]) for r in run(cases, passages, recorder(folder, lambda p: GOOD), store(), CALLS, wave=2).collect()}
    assert sorted(found) == [f"case_000{i}" for i in range(1, 5)] and len(asked(folder)) == 8
    one = found["case_0001"]["outputs"]
    assert [o["configuration"] for o in one] == conf.CONFIGURATIONS and all(o["status"] == "ok" for o in one)
    fixed, direct, rules, model = one
    assert direct["confirmed"] == {"who": "Ana", "what": "ignored"} and len(direct["evidence"]) == 1
    # rules keep what the request confirms; the model adds to it
    assert model["confirmed"]["what"] == rules["confirmed"]["what"] != "ignored" and model["confirmed"]["who"] == "Ana"
    assert model["missing"] == rules["missing"] and "Zebra crossing" in rules["claims"] and "Too far" not in rules["briefing"]
    # the same claim has evidence where the passage was seen, and none where it was not
    assert direct["scores"]["claims_supported"] == 0 and model["scores"]["claims_supported"] == 1
    assert sum("Signals:" in p for p in asked(folder)) == 4 and not any("SHORT_JSON" in p for p in asked(folder))
    assert not any("Zebra" in p for p in asked(folder) if "Signals:" not in p)


def test_stopped_and_resumed_without_a_second_call(spark, made):
    cases, passages, folder, store = made

    def dies(prompt):
        if "Title 3" in prompt:
            raise RuntimeError("killed")
        return GOOD

    with pytest.raises(Exception, match="killed"):
        run(cases, passages, recorder(folder, dies), store(), CALLS, wave=1)
    saved = {r["case_id"] for r in store().records().collect()}
    before = asked(folder)
    assert "case_0003" not in saved
    assert run(cases, passages, recorder(folder, lambda p: GOOD), store(), CALLS, wave=1).count() == 4
    again = [p for p in asked(folder)]
    for case in saved:
        title = f"Title {case[-1]}"
        assert sum(title in p for p in again) == sum(title in p for p in before) == 2
    n = len(again)
    run(cases, passages, recorder(folder, lambda p: GOOD), store(), CALLS, wave=1)
    assert len(asked(folder)) == n


def test_retries_with_a_shorter_instruction(spark, made):
    cases, passages, folder, store = made
    answer = lambda p: GOOD if "SHORT_JSON" in p else "not-json"
    found = run(cases.where("case_id = 'case_0001'"), passages, recorder(folder, answer), store(), CALLS)
    outputs = json.loads(found.first()["record"])["outputs"]
    assert [o["attempts"] for o in outputs] == [0, 2, 0, 2] and not any(o.get("parse_error") for o in outputs)
    assert sorted("SHORT_JSON" in p for p in asked(folder)) == [False, False, True, True]


def test_cases_without_a_readable_answer_are_not_committed(spark, made):
    cases, passages, folder, store = made
    answer = lambda p: "[1]" if "Title 2" in p else GOOD
    with pytest.raises(IncompleteRunError, match="1 cases"):
        run(cases, passages, recorder(folder, answer), store(), CALLS, parse_retries=1)
    assert store().remaining(cases).select("case_id").collect()[0]["case_id"] == "case_0002"
    assert run(cases, passages, recorder(folder, lambda p: GOOD), store(), CALLS).count() == 4


def test_without_a_model(spark, made):
    cases, passages, _, store = made
    record = json.loads(run(cases, passages, None, store(), CALLS).where("case_id = 'case_0001'").first()["record"])
    assert [o["status"] for o in record["outputs"]] == ["ok", "requires_model", "ok", "requires_model"]
    assert record["outputs"][3]["confirmed"] == record["outputs"][2]["confirmed"] and record["outputs"][3]["briefing"] == ""


def test_bound_on_calls_under_way(spark, tmp_path):
    def model(prompt):
        begun = time.time()
        time.sleep(0.05)
        with open(f"{tmp_path}/{prompt}", "w") as f:
            f.write(f"{begun} {time.time()}")
        return prompt

    found = ask(spark.range(30).selectExpr("cast(id as string) as prompt"), model, Calls(tasks=1, in_flight=3)).collect()
    assert sorted(r["response"] for r in found) == sorted(map(str, range(30))) and all(r["calls"] == 1 for r in found)
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    under_way = max(sum(a <= t < b for a, b in spans) for t, _ in spans)
    assert under_way == 3


def test_passing_failures(spark):
    def busy(prompt):
        raise Busy("429")

    row = ask(spark.createDataFrame([(None,)], "prompt string"), busy, Calls(tasks=1, retries=2, pause=0.0)).first()
    assert (row["response"], row["calls"], row["status"], row["status_reason"]) == (None, 3, "failed", "429")
    assert ask(spark.createDataFrame([], "prompt string"), busy, Calls(tasks=1)).count() == 0
    with pytest.raises(ValueError):
        Calls(in_flight=0)
