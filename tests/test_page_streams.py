"""Streams of pages over a table that is a folder of files, in an order that is not that of its pages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textmill.operators import html
from textmill.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for low in (30, 0, 15):  # later pages in the file that was there first
        last = low + 15 if low < 30 else 1 << 40
        pages.where(F.col("page_id").between(low, last - 1)).coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["st4_known_addresses", "st5_stop_pages", "c7_crawl_log", "c7_crawl_articles"])
def test_a_folder_of_files(spark, parts, name):
    found = catalogue.queries()[name](spark, parts)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{parts}/pages.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name]).fetchall()
    columns = con.sql(catalogue.oracle_sql()[name]).columns
    assert want and sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(want, key=repr)


def test_links_of_a_folder_of_files(spark, parts):
    columns = ["id", "page_id", "normalized", "link_type"]
    query = catalogue.queries()["c7_crawl_links"]
    one, many = (sorted(map(tuple, query(spark, folder).select(columns).collect()), key=repr) for folder in (SF, parts))
    assert one and one == many


def test_links_are_those_of_all_pages(spark, tmp_path):
    """Pages that come again, of which every walk with stops would leave most out."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    copies = pages.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).withColumn("page_id", F.col("page_id") + F.col("copy") * 1000).drop("copy")
    copies.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    want = html.links_of(html.articles(pages), "example.org").select("page_id", "normalized", "link_type", "should_download").collect()
    found = catalogue.queries()["c7_crawl_links"](spark, str(tmp_path)).collect()
    assert sorted((r["page_id"] % 1000, r["normalized"], r["link_type"], r["should_download"]) for r in found) == sorted([tuple(r) for r in want] * 4)
    assert sorted(r["id"] for r in found) == [f"lnk_{i + 1:08d}" for i in range(len(found))] and len({r["page_id"] for r in found}) > pages.count()
