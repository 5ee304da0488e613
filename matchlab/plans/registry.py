"""Registry of named queries: Spark builder + DuckDB oracle SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None, extra_ctes: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``key`` with its oracle SQL
    (omit ``sql`` for rows-only checked queries)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = with_views(sql, extra_ctes)
        return fn
    return deco


def r6(c, name: str | None = None) -> Column:
    """Round a double to 6 places for comparison."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), 6)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def big(c, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("long").alias(name or (c if isinstance(c, str) else "n"))
