"""Streams over the event files, run until all is read; the SQL is the same over the whole table.

The order of the files of a table says nothing about that of its rows, so what is there is one batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import urls
from ..sources.scratch import shared_dir
from ..streaming import checkpoint, crawl_run, events
from .page_queries import NORMALIZED, WALK
from .registry import query, read


@query("SELECT event_id, event_type, value FROM events WHERE value > 10")
def st1_resume(spark, sf_dir):
    """Two runs with one checkpoint: the second finds nothing new."""
    base = f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    for _ in range(2):
        rows = events.stream(spark, sf_dir, "events", None).where("value > 10").select("event_id", "event_type", "value")
        found = events.drain(rows, "append", f"{base}/checkpoint", f"{base}/table")
    return found


@query("SELECT DISTINCT user_id, event_type FROM events")
def st2_dedupe(spark, sf_dir):
    return events.drain(events.first_seen(events.stream(spark, sf_dir, "events", None), "user_id", "event_type"), "append")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL")
def st6_tumbling(spark, sf_dir):
    return events.drain(events.tumbling(events.stream(spark, sf_dir, "events", None), "1 hour", "event_type"), "complete")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR * k AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL")
def st6_sliding(spark, sf_dir):
    return events.drain(events.sliding(events.stream(spark, sf_dir, "events", None), "2 hours", "1 hour", "event_type"), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def st6_session(spark, sf_dir):
    return events.drain(events.sessions(events.stream(spark, sf_dir, "events", None), "30 minutes", "user_id"), "complete")


@query(f"WITH n AS (SELECT page_id, url, {NORMALIZED} AS normalized FROM pages) SELECT normalized, min(page_id) AS first_id, min_by(url, page_id) AS first_url, (count(DISTINCT url) - 1)::INT AS alternatives FROM n GROUP BY 1")
def st4_known_addresses(spark, sf_dir):
    rows = events.pages(spark, sf_dir, None).select("page_id", "url", urls.normalize_url(F.col("url")).alias("normalized"))
    return events.drain(events.known_addresses(rows, "page_id", "url"), "complete")


@query("WITH w AS (SELECT page_id % 10 AS source, page_id // 10 AS page, md5((length(html) % 60)::VARCHAR) AS fp FROM pages) SELECT source, min(page) AS stop_page FROM (SELECT source, page, row_number() OVER (PARTITION BY source, fp ORDER BY page) AS n FROM w) WHERE n > 1 GROUP BY 1")
def st5_stop_pages(spark, sf_dir):
    page = F.col("page_id")
    walk = events.pages(spark, sf_dir, None).select((page % 10).alias("source"), F.floor(page / 10).alias("page"), F.md5((F.length("html") % 60).cast("string").cast("binary")).alias("fp"))
    return events.drain(events.stops(walk, "source", "page", "fp"), "append")


#: Records of cases made from the events: every 50th is broken off, every 77th has no valid case id, and keys stand in two orders.
_RECORD = """CASE WHEN event_id % 50 = 7 THEN '{"case": {"case_id": "' WHEN event_id % 77 = 5 THEN '{"case": {"case_id": "x"}}'
  WHEN event_id % 2 = 0 THEN '{"case": {"case_id": "case_' || lpad(CAST(user_id AS STRING), 6, '0') || '"}, "outputs": ["' || event_type || '"]}'
  ELSE '{"outputs":["' || event_type || '"],"case":{"case_id":"case_' || lpad(CAST(user_id AS STRING), 6, '0') || '"}}' END"""


@query("""WITH r AS (SELECT event_id, 'case_' || lpad(user_id::VARCHAR, 6, '0') AS case_id, event_type, CASE WHEN event_id % 50 = 7 THEN 'no JSON' WHEN event_id % 77 = 5 THEN 'invalid case_id' END AS reason FROM events),
f AS (SELECT case_id, min(event_id) AS first, arg_min(event_type, event_id) AS kept FROM r WHERE reason IS NULL GROUP BY 1)
SELECT event_id AS position, CASE WHEN reason IS NULL THEN case_id END AS case_id, coalesce(reason, CASE WHEN event_id = first THEN 'saved' ELSE 'conflict' END) AS status FROM r LEFT JOIN f USING (case_id) WHERE reason IS NOT NULL OR event_id = first OR event_type <> kept""")
def c33_checkpoint_store(spark, sf_dir):
    """What a store makes of a stream of records: cases saved, records that differ from what is saved, and broken ones."""
    store = checkpoint.CheckpointStore.create_or_open(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", {"seed": 42, "masking": "balanced"})
    store.commit(events.stream(spark, sf_dir, "events", None).select(F.col("event_id").alias("position"), F.expr(_RECORD).alias("record")), strict=False)
    return store.cases().select("position", "case_id", "status").unionByName(store.corrupt().select("position", F.lit(None).cast("string").alias("case_id"), F.col("reason").alias("status")))


_ENDED = f"""s AS (SELECT *, row_number() OVER (PARTITION BY source, fp ORDER BY page) > 1 AS seen, page_id FROM (SELECT w.*, page * 10 + source AS page_id FROM {WALK} w)),
r AS (SELECT *, CASE WHEN status <> 200 THEN 'not_found' WHEN size < 200 THEN 'small_page' WHEN seen THEN 'repeated_page' WHEN links = 0 THEN 'no_links' END AS why FROM s),
e AS (SELECT source, min(page) FILTER (why IS NOT NULL) AS stop_page, min_by(why, page) FILTER (why IS NOT NULL) AS ended FROM r GROUP BY 1),
f AS (SELECT r.*, CASE WHEN stop_page IS NULL OR page < stop_page THEN 'taken' WHEN page = stop_page THEN 'stopped' ELSE 'skipped' END AS action, CASE WHEN page = stop_page THEN ended WHEN page > stop_page THEN 'after_' || ended END AS reason FROM r JOIN e USING (source))"""


def crawled(spark, sf_dir, ends=True):
    """A run over the pages as ten sources fetched them, and a second call that finds nothing new. Without ``ends`` no page gives a reason to stop, so all are taken."""
    run = crawl_run.CrawlRun(spark, f"{shared_dir(spark)}/crawl-{uuid.uuid4().hex}", "example.org", read(spark, sf_dir, "pages").select("page_id", "html"))
    page = F.col("page_id")
    status = F.when(page % 83 == 82, 404).otherwise(200) if ends else F.lit(200)
    mark, links = (F.left(F.md5("html"), F.lit(2)), F.regexp_count("html", F.lit("<a "))) if ends else (page.cast("string"), F.lit(1))
    for _ in range(2):
        fetched = events.pages(spark, sf_dir, None).select((page % 10).alias("source"), F.floor(page / 10).alias("page"), "page_id", "url", status.alias("status"), "html")
        run.advance(crawl_run.walk(fetched, mark, links, least=200 if ends else 0, bodies=False))
    return run


@query(f"WITH {_ENDED} SELECT printf('log_%08d', row_number() OVER (ORDER BY page_id)) AS id, source, page, page_id, status, action, reason FROM f")
def c7_crawl_log(spark, sf_dir):
    return crawled(spark, sf_dir).table("log").select("id", "source", "page", "page_id", "status", "action", "reason")


@query(f"WITH {_ENDED} SELECT printf('art_%08d', row_number() OVER (ORDER BY page_id)) AS id, page_id FROM f WHERE action = 'taken'")
def c7_crawl_articles(spark, sf_dir):
    return crawled(spark, sf_dir).table("articles").select("id", "page_id")


@query()
def c7_crawl_links(spark, sf_dir):
    """The links of all pages: walks that end early would leave most of a large table unread."""
    return crawled(spark, sf_dir, ends=False).table("links").select("id", "article_id", "page_id", "normalized", "link_type", "should_download")
