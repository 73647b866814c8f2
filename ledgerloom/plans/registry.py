"""All registered queries of the register engine, with the SQL that checks them."""

from __future__ import annotations

from . import detail_queries, ingest_queries, register_queries, report_queries, search_queries, stream_queries, text_queries  # noqa: F401
from .base import ORACLES, QUERIES

FLAGSHIP = "rrf"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
