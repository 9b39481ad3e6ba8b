"""Named queries, each with its DuckDB twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from routescope.plans.sqlviews import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL_OF: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL_OF[name] = sql
        return fn

    return keep


def oracles() -> dict[str, str]:
    """SQL twins with the views they use, resolved once all views are known."""
    return {name: with_views(sql) for name, sql in SQL_OF.items()}
