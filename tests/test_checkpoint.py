"""The checkpoint store: repeats, conflicts, corrupt records, other fingerprints, and a stream that goes on after a stop."""

import json

import pytest

from textmill.streaming import checkpoint

PRINT = {"seed": 42, "case_count": 3, "model": "m"}


def record(case, output, **more):
    return json.dumps({"case": {"case_id": case}, "outputs": [output], **more})


@pytest.fixture
def feed(spark, tmp_path):
    """Adds files of (position, record) to a folder and gives the stream over it."""
    folder = tmp_path / "in"
    folder.mkdir()

    def add(*rows):
        if rows:
            spark.createDataFrame(list(rows), "position long, record string").coalesce(1).write.mode("append").parquet(str(folder))
        return spark.readStream.schema("position long, record string").option("maxFilesPerTrigger", 1).parquet(str(folder))

    return add


def open_store(spark, tmp_path, fingerprint=PRINT):
    return checkpoint.CheckpointStore.create_or_open(spark, f"file://{tmp_path}/store", fingerprint)


def test_saves_reopens_and_goes_on(spark, tmp_path, feed):
    open_store(spark, tmp_path).commit(feed((1, record("case_0002", "a")), (2, record("case_0001", "b"))))
    again = open_store(spark, tmp_path)
    # a repeat with keys in another order is nothing; the second call reads the new file only
    swapped = json.dumps({"outputs": ["a"], "case": {"case_id": "case_0002"}})
    again.commit(feed((3, swapped), (4, record("case_0003", "c"))))
    again.commit(feed())
    assert [r["case_id"] for r in again.records().orderBy("case_id").collect()] == ["case_0001", "case_0002", "case_0003"]
    cases = spark.createDataFrame([("case_0001",), ("case_0009",)], "case_id string")
    assert [r["case_id"] for r in again.remaining(cases).collect()] == ["case_0009"]


def test_refuses_another_fingerprint(spark, tmp_path):
    open_store(spark, tmp_path)
    open_store(spark, tmp_path, dict(reversed(PRINT.items())))
    with pytest.raises(checkpoint.CheckpointMismatchError, match="does not match"):
        open_store(spark, tmp_path, PRINT | {"seed": 43})


def test_another_content_is_an_error(spark, tmp_path, feed):
    store = open_store(spark, tmp_path)
    store.commit(feed((1, record("case_0001", 1))))
    with pytest.raises(checkpoint.DuplicateCheckpointError, match="case_0001"):
        store.commit(feed((2, record("case_0001", 2)), (3, record("case_0001", 1))))
    assert json.loads(store.records().first()["record"])["outputs"] == [1]


@pytest.mark.parametrize("text, reason", [('{"case":', "no JSON"), (None, "no JSON"), ("[1]", "no object"), ('{"case": 3}', "no case"), ("{}", "no case"), ('{"case": {"case_id": "x1"}}', "invalid case_id"), ('{"case": {}}', "invalid case_id")])
def test_reports_corrupt_records(spark, tmp_path, feed, text, reason):
    store = open_store(spark, tmp_path)
    with pytest.raises(checkpoint.CheckpointCorruptionError, match=f"record 7: {reason}"):
        store.commit(feed((6, record("case_0001", 1)), (7, text)))
    assert store.records().count() == 1


def test_changed_files_are_found(spark, tmp_path, feed):
    store = open_store(spark, tmp_path)
    store.commit(feed((1, record("case_0001", 1))))
    rows = store.cases().collect()
    spark.createDataFrame([(*rows[0][:2], rows[0]["canonical"].replace("1", "2"), *rows[0][3:])], store.cases().schema).write.mode("append").parquet(f"{store.path}/cases/batch=9")
    with pytest.raises(Exception, match="corrupt checkpoint of case_0001"):
        store.records().collect()


def test_a_commit_reads_a_record_once_and_keeps_no_state(spark, tmp_path, feed):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    store = open_store(spark, tmp_path)
    store.commit(feed(*((i, record(f"case_{i % 5:04d}", i % 2)) for i in range(40)), (40, "{")).select("position", counted("record").alias("record")), strict=False)
    assert seen.value == 41
    assert not list(tmp_path.glob("store/*/state"))
    assert sorted(r["position"] for r in store.conflicts().collect()) == [i for i in range(40) if i % 2 != i % 5 % 2]
    assert [r["position"] for r in store.corrupt().collect()] == [40]


def test_a_repeated_batch_replaces_itself(spark, tmp_path, feed):
    store = open_store(spark, tmp_path)
    store.commit(feed((1, record("case_0001", 1)), (2, record("case_0002", 1))))
    more = feed((0, record("case_0001", 2)), (3, record("case_0003", 1)), (4, record("case_0003", 2)), (5, "{"))
    store.commit(more, strict=False)
    told = lambda: (sorted(map(tuple, store.cases().collect())), store.corrupt().collect())
    before = told()
    # as after a failure before the batch was marked as done
    for at in [*tmp_path.glob("store/*/commits/1"), *tmp_path.glob("store/*/commits/.1.crc")]:
        at.unlink()
    store.commit(more, strict=False)
    assert told() == before
    # the record saved first stays, though another one has a smaller position
    assert [(r["case_id"], r["position"]) for r in store.conflicts().orderBy("case_id").collect()] == [("case_0001", 0), ("case_0003", 4)]


def test_records_of_one_position_are_one_case(spark, tmp_path, feed):
    store = open_store(spark, tmp_path)
    store.commit(feed((1, record("case_0001", 1)), (1, record("case_0001", 1)), (None, record("case_0001", 1)), (None, record("case_0002", 1)), (None, record("case_0002", 1))))
    assert [(r["case_id"], r["position"]) for r in store.cases().orderBy("case_id").collect()] == [("case_0001", 1), ("case_0002", None)]
