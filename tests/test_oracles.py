"""Every query with SQL against DuckDB over the smallest tables; the others run and keep a schema."""

import os

import duckdb
import pytest

from textmill.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 8) if isinstance(value, float) else value


def rows_of(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = df.collect()
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(found, df.columns) == rows_of(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - {"c11_train"}))
def test_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
