"""The order of attempts: every rung from a scripted fetcher, records, choice, delays of a host over several tasks."""

import ssl

from textmill.sources import attempts
from textmill.sources.attempts import AGAIN, FIRST, PLAIN, UNVERIFIED, Ladder


def script(url, verify, timeout):
    """What an address does stands in its path."""
    name = url.split("/")[3]
    if name == "tls" and verify:
        raise ssl.SSLError("bad certificate")
    if name == "down":
        raise TimeoutError("no answer")
    if name == "plain" and url.startswith("https:"):
        raise ConnectionError("refused")
    status = {"busy": 503, "gone": 404, "moved": 200}.get(name, 200)
    return status, url + "/end" if name == "moved" else url, "" if status != 200 else "<p>thin</p>" if name == "thin" else f"<p>{name} {verify}</p>"


def tried(spark, rows, ladder, **more):
    table = spark.createDataFrame(rows, "page_id long, url string")
    return attempts.attempts(table, script, ladder, pause=lambda s: None, clock=lambda: 0.0, **more)


def steps(found):
    by: dict = {}
    for r in found.orderBy("page_id", "n").collect():
        by.setdefault(r["page_id"], []).append((r["rung"], r["retry"], r["status"], r["verify"]))
    return by


def test_source_ladder(spark):
    rows = [(1, "https://a.org/ok"), (2, "https://a.org/busy"), (3, "https://old.org/plain"), (4, "https://a.org/gone"), (5, "https://x.old.org/tls"), (6, "https://a.org/down"), (7, None), (8, "ftp://a.org/x"), (9, "http://old.org/down"), (10, "https://a.org/moved")]
    found = tried(spark, rows, Ladder(unverified_hosts=("old.org",), plain_hosts=("old.org",))).cache()
    by = steps(found)
    assert by[1] == [(FIRST, 0, 200, True)] and by[4] == [(FIRST, 0, 404, True)] and by[5] == [(FIRST, 0, 200, False)]
    assert by[2] == [(FIRST, i, 503, True) for i in range(3)] and by[6] == [(FIRST, i, None, True) for i in range(3)]
    assert by[3] == [(FIRST, i, None, False) for i in range(3)] + [(PLAIN, 0, 200, False)] and by[9] == [(FIRST, i, None, False) for i in range(3)]
    assert by[7] == by[8] == [(FIRST, 0, None, False)]
    taken = {r["page_id"]: r for r in attempts.selected(found).collect()}
    assert len(taken) == 10 and taken[3]["request_url"] == "http://old.org/plain" and taken[3]["fallback_used"] and taken[3]["attempts"] == 4
    assert taken[2]["status"] == 503 and not taken[2]["success"] and taken[6]["error_type"] == "TimeoutError" and taken[7]["error_type"] == "InvalidAddress"
    assert taken[10]["redirected"] and not taken[1]["redirected"]


def test_diagnostic_ladder(spark):
    found = tried(spark, [(1, "https://a.org/tls"), (2, "https://a.org/busy"), (3, "https://a.org/down")], attempts.DIAGNOSTIC).cache()
    assert steps(found) == {1: [(FIRST, 0, None, True), (UNVERIFIED, 0, 200, False)], 2: [(FIRST, 0, 503, True)], 3: [(FIRST, 0, None, True)]}
    taken = {r["page_id"]: r for r in attempts.selected(found).collect()}
    assert taken[1]["success"] and taken[1]["verify_false_needed"] and "bad certificate" in taken[1]["tls_error"] and taken[1]["html"] == "<p>tls False</p>"
    assert not taken[3]["verify_false_needed"] and taken[3]["tls_error"] == ""


def test_weak_pages_are_fetched_again(spark):
    ladder = Ladder(again=2, weak=lambda h: "thin" in h, score=len)
    found = tried(spark, [(1, "https://a.org/thin"), (2, "https://a.org/ok")], ladder).cache()
    assert [s[:2] for s in steps(found)[1]] == [(FIRST, 0), (AGAIN, 1), (AGAIN, 2)] and len(steps(found)[2]) == 1
    rows = [(1, 0, True, True, 5), (1, 1, True, True, 9), (1, 2, True, True, 9), (2, 0, False, False, 0), (2, 1, False, False, 0), (3, 0, True, True, 9), (3, 1, True, False, 3)]
    table = spark.createDataFrame(rows, "page_id long, n int, success boolean, weak boolean, score int").selectExpr("*", "concat('u', n) request_url", *(f"'' {c}" for c in ("asked_url", "final_url", "html", "error_type", "error_message")), "200 status", *(f"false {c}" for c in ("redirected", "verify", "tls_failed")), "'first' rung")
    assert {r["page_id"]: r["request_url"] for r in attempts.selected(table).collect()} == {1: "u1", 2: "u1", 3: "u1"}


def test_delays_hold_for_a_host(spark):
    ladder = Ladder(retries=1, delay=0.5, backoff=3.0, tasks_a_host=2)
    found = tried(spark, [(i, f"https://a.org/ok{i}") for i in range(40)] + [(99, "https://b.org/down")], ladder).cache()
    waits = sorted(r["waited"] for r in found.where("page_id < 99").collect())
    # the clock stands still, so the k-th request of a task waits k delays times the tasks of the host
    assert waits.count(0.0) == 2 and all(w % 1.0 == 0 for w in waits) and max(waits) <= 40
    assert [r["waited"] for r in found.where("page_id = 99").orderBy("n").collect()] == [0.0, 3.0]
    assert tried(spark, [], ladder).count() == 0
