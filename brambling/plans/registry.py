"""Named queries of the retrieval engine and their SQL."""

from __future__ import annotations

from brambling.plans import text_queries, visual_queries


def queries() -> dict:
    return text_queries.QUERIES | visual_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return text_queries.sql() | visual_queries.sql()
