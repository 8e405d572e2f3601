"""Character references that were cut, against the SQL of the queries that read lines, blocks and links."""

import duckdb
import pytest

from textmill.plans import catalogue

MENU = "".join(f'<li><a href="/M{i}">m{i}</a></li>' for i in range(6))
ENDS = ["a &quot", "a &quo", "a &copy", "a &middot", "a &amp", "a &am", "a &", "a &quot;b &ampquot; &amp;quot;", "a &copyx;", "a &quot9c &copy; &middot;"]


@pytest.mark.parametrize("name", ["h23_lines", "h25_line_scan", "h26_link_union", "h27_content_blocks"])
def test_cut_references_stay_text(spark, tmp_path, name):
    pages = [(i, "http://a.example.org/", f'<html><head><title>t</title></head><body><ul>{MENU}</ul><article><h1>{e}</h1><p>{e}</p><p><a href="/X?{e[2:]}">um</a> dois</p></article></body></html>') for i, e in enumerate(ENDS)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    found = catalogue.queries()[name](spark, str(tmp_path)).select(want.columns).collect()
    assert found and sorted(map(tuple, found), key=repr) == sorted(want.fetchall(), key=repr)
