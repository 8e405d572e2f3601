import json

import pytest

from textmill.sources import readers, sinks


def test_atomic_json_replaces_the_document(spark, tmp_path):
    path = str(tmp_path / "state.json")
    for value in ({"b": 1, "a": ["é"]}, {"a": []}):
        sinks.atomic_json(spark, path, value)
        assert json.loads((tmp_path / "state.json").read_text()) == value
    assert not list(tmp_path.glob("*.tmp"))


def test_initialise_aliases_and_run_paths(spark, tmp_path):
    path = str(tmp_path / "table")
    sinks.initialise(spark, path, "a int")
    sinks.append(spark.createDataFrame([(1,)], "a int"), path)
    sinks.initialise(spark, path, "a int", afresh=False)
    sinks.aliases(spark, {"paper_table": path})
    assert spark.table("paper_table").count() == 1
    sinks.initialise(spark, path, "a int")
    assert spark.read.parquet(path).count() == 0
    with pytest.raises(ValueError):
        sinks.checked_run_paths(spark, str(tmp_path), f"{tmp_path}/")
    with pytest.raises(ValueError):
        sinks.checked_run_paths(spark, path, str(tmp_path))
    (tmp_path / "table" / "checkpoint").mkdir()
    assert sinks.checked_run_paths(spark, path, str(tmp_path)) == path


def test_reports_tell_what_they_leave_out(spark):
    rows = spark.range(5)
    assert "(first 3 rows)" in sinks.latex(rows, 3) and "(first" not in sinks.latex(rows, 5)


def test_broken_lines_are_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{broken\n')
    with pytest.raises(Exception):
        readers.jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()
