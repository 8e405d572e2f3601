"""All queries of the engine by name, with their DuckDB SQL."""

from __future__ import annotations

from . import corpus_queries, dedupe_queries, evaluation_queries, listing_queries, more_queries, page_queries, portal_queries, retrieval_queries, stream_queries, strict_queries, survey_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
