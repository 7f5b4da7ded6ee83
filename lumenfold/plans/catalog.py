"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from lumenfold.plans import package_queries, record_queries, source_queries, text_queries, time_queries

FLAGSHIP = "run_summary"
PARTS = (record_queries, text_queries, time_queries, package_queries, source_queries)


def queries() -> dict:
    return {name: run for part in PARTS for name, (run, _) in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
