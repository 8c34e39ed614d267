"""Named queries: each is ``fn(spark, sf_dir) -> DataFrame`` with an optional
DuckDB oracle SQL string (tables pre-registered as views)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add ``fn`` under ``name`` (and its oracle SQL when given)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from churnlab.plans import queries  # noqa: F401
