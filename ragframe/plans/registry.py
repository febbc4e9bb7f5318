"""All registered queries and their oracle SQL (DuckDB)."""

from __future__ import annotations

from . import ingest_queries, loop_queries, state_queries, store_queries, text_queries


def _all() -> dict:
    return {**ingest_queries.QUERIES, **text_queries.QUERIES, **state_queries.QUERIES, **loop_queries.QUERIES, **store_queries.QUERIES}


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _all().items() if sql}
