"""Registry of runnable queries: name -> (callable(spark, sf_dir), oracle SQL or None).

Each plan module registers its queries at import time; ``__spark_entry__``
exposes them as ``queries()`` / ``oracle_sql()``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir)`` under ``name`` with its oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query name {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql.strip()
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """One driver table (a parquet file or folder under ``sf_dir``); a scan with
    fewer splits than cores is spread first (see ``spread_narrow_scan``) unless
    ``spread=False`` (footer-only work such as counts)."""
    from seqlake.sources.corpus import spread_narrow_scan
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread_narrow_scan(df) if spread else df
