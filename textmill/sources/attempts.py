"""Fetching with an order of attempts, one record for each of them.

The order is a state machine of rungs: the address as it is (verified, unless its host is known to fail that), then
without verification where only that failed, then by plain HTTP where the host allows it, and again while a page that
came looks weak. A rung is tried again while its status may pass. The function that gets a page is the caller's.

Addresses of one host are dealt over several tasks. Each of them waits as many times longer as there are, so the host sees
no more than one request in a delay without any state that tasks share. Addresses that are null or not http end at once,
with a record that says so. Repeated addresses are fetched for each of their rows.
"""

from __future__ import annotations

import ssl
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import urls
from .readers import RETRIED

FIRST, UNVERIFIED, PLAIN, AGAIN = "first", "unverified", "plain", "again"
#: A task hands its records on when they hold this much text.
HANDED_ON = 8 << 20

Get = Callable[[str, bool, float], tuple[int, str, str]]


@dataclass(frozen=True)
class Ladder:
    """What is tried after what.

    Hosts of ``unverified_hosts`` (and below them) are never verified; those of ``plain_hosts`` are tried by HTTP after
    HTTPS failed. ``unverified_on_tls`` tries an address without verification if that is what failed. A page that
    ``weak`` holds for is fetched up to ``again`` times more, and the one of the highest ``score`` is taken.
    """

    retries: int = 2
    delay: float = 0.5
    timeout: float = 30.0
    backoff: float = 0.75
    unverified_hosts: tuple[str, ...] = ()
    plain_hosts: tuple[str, ...] = ()
    unverified_on_tls: bool = False
    again: int = 0
    weak: Callable[[str], bool] | None = None
    score: Callable[[str], int] | None = None
    tasks_a_host: int = 4

    def within(self, host: str, hosts: tuple[str, ...]) -> bool:
        return any(host == h or host.endswith("." + h) for h in hosts)

    def after(self, host: str, secure: bool, at: tuple[str, int], success: bool, status: int | None, tls: bool, weak: bool) -> tuple[str, int] | None:
        """The rung and retry after one that ended so; None at the end."""
        rung, retry = at
        if success:
            tried = retry if rung == AGAIN else 0
            return (AGAIN, tried + 1) if weak and tried < self.again else None
        if rung == AGAIN:
            return (AGAIN, retry + 1) if retry < self.again else None
        if (status is None or status in RETRIED) and retry < self.retries:
            return rung, retry + 1
        if rung == FIRST and tls and self.unverified_on_tls:
            return UNVERIFIED, 0
        if rung in (FIRST, UNVERIFIED) and secure and self.within(host, self.plain_hosts):
            return PLAIN, 0
        return None


#: A source is retried; a diagnosis asks once, and once more without verification.
SOURCE, DIAGNOSTIC = Ladder(), Ladder(retries=0, delay=0.25, timeout=25.0, unverified_on_tls=True)

_STRINGS, _FLAGS = ("final_url", "html", "error_type", "error_message"), ("verify", "success", "redirected", "tls_failed", "weak")
RECORD = StructType([
    StructField("asked_url", StringType()), StructField("n", IntegerType()), StructField("rung", StringType()), StructField("retry", IntegerType()), StructField("request_url", StringType()), StructField("status", IntegerType()),
    *(StructField(n, StringType()) for n in _STRINGS), *(StructField(n, BooleanType()) for n in _FLAGS), StructField("score", IntegerType()), StructField("waited", DoubleType()),
])


def climb(url: str, host: str, ladder: Ladder, get: Get, wait: Callable[[float], float]) -> Iterator[dict]:
    """The attempts on one address. ``wait`` is given the seconds of back-off and returns those it waited in all."""
    secure = url.lower().startswith("https:")
    at, n, verified = (FIRST, 0), 0, not ladder.within(host, ladder.unverified_hosts)
    plain = trusting = False
    while at is not None:
        rung, retry = at
        plain, trusting = plain or rung == PLAIN, trusting or rung in (UNVERIFIED, PLAIN)
        request = "http:" + url[6:] if plain else url
        waited = wait(ladder.backoff * 2 ** (retry - 1) if retry and rung != AGAIN else 0.0)
        record = {"asked_url": url, "n": n, "rung": rung, "retry": retry, "request_url": request, "status": None, "final_url": None, "html": "", "error_type": "", "error_message": "", "verify": verified and not trusting, "tls_failed": False, "waited": waited}
        try:
            record["status"], record["final_url"], record["html"] = get(request, record["verify"], ladder.timeout)
        except OSError as e:
            record.update(error_type=type(e).__name__, error_message=str(e), tls_failed=isinstance(e, ssl.SSLError))
        html, status = record["html"] or "", record["status"]
        success = status is not None and 200 <= status < 400
        weak = success and ladder.weak is not None and ladder.weak(html)
        record.update(html=html, success=success, weak=weak, redirected=bool(record["final_url"]) and record["final_url"] != request, score=ladder.score(html) if success and ladder.score else 0)
        yield record
        n += 1
        at = ladder.after(host, secure, at, success, status, record["tls_failed"], weak)


def attempts(targets: DataFrame, get: Get, ladder: Ladder = SOURCE, key: str = "page_id", url: str = "url", clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """One row for each attempt on each address, by ``key`` and ``n`` from 0."""
    shards = ladder.tasks_a_host
    between = ladder.delay * shards

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[tuple[str, int], float] = {}
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for k, address, host, shard in zip(batch["_key"], batch["_url"], batch["_host"], batch["_shard"]):
                place = (host, shard)

                def wait(backoff: float, place=place) -> float:
                    now = clock()
                    seconds = max(backoff, last[place] + between - now if place in last else 0.0)
                    if seconds > 0:
                        pause(seconds)
                    last[place] = now + seconds
                    return seconds

                if address is None or not address.lower().startswith(("http://", "https://")):
                    empty = dict.fromkeys(RECORD.names)
                    rows.append({**empty, "_key": k, "asked_url": address, "n": 0, "rung": FIRST, "retry": 0, "html": "", "error_type": "InvalidAddress", "error_message": "no http address", **dict.fromkeys(_FLAGS, False), "score": 0, "waited": 0.0})
                    continue
                for record in climb(address, host, ladder, get, wait):
                    rows.append({"_key": k, **record})
                    held += len(record["html"])
                if held > HANDED_ON:
                    yield pd.DataFrame(rows, columns=["_key", *RECORD.names])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["_key", *RECORD.names])
                rows, held = [], 0

    asked = targets.select(F.col(key).alias("_key"), F.col(url).alias("_url"), urls.host(F.col(url)).alias("_host"), F.pmod(F.xxhash64(F.col(url)), F.lit(shards)).cast("int").alias("_shard"))
    schema = StructType([StructField("_key", targets.schema[key].dataType), *RECORD.fields])
    return asked.repartition("_host", "_shard").mapInPandas(run, schema).withColumnRenamed("_key", key)


def selected(tried: DataFrame, key: str = "page_id") -> DataFrame:
    """The attempt to take for each key: the first that came and is not weak, else the best that came, else the last.

    With it, whether verification had to be left out, the first TLS error, whether plain HTTP was tried, and how many
    attempts were made.
    """
    good = F.col("success") & ~F.col("weak")
    order = F.struct(~good, F.when(good, F.col("n")).otherwise(0), ~F.col("success"), -F.col("score"), F.when(F.col("success"), F.col("n")).otherwise(-F.col("n")))
    fields = ["asked_url", "request_url", "final_url", "status", "success", "redirected", "verify", "html", "error_type", "error_message", "score"]
    tls = F.min_by("error_message", F.when(F.col("tls_failed"), F.col("n")))
    return tried.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("s"), F.bool_or(F.col("rung") == UNVERIFIED).alias("verify_false_needed"), F.coalesce(tls, F.lit("")).alias("tls_error"), F.bool_or(F.col("rung") == PLAIN).alias("fallback_used"), F.count("*").alias("attempts")).select(key, "s.*", "verify_false_needed", "tls_error", "fallback_used", "attempts")
