"""Registry of queries and of the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.sqlviews import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: Sequence[str] = ()):
    """Register a query; ``sql`` is completed with the common table expressions named in ``views``."""

    def add(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return add


def load() -> None:
    """Import every module that registers queries."""
    from shelfwise.plans import cleaning, lookups, markets, pages, pricing, reviewing, snapshots, streams, titles  # noqa: F401
