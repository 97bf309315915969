"""Registry of named checks: a Spark query and (when SQL-expressible) the
DuckDB text that must give the same rows.

Each query module decorates functions ``(spark, sf_dir) -> DataFrame`` with
:func:`query`; ``__spark_entry__`` exposes the registry to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``name``; ``sql`` is the oracle text (None -> rows-only check)."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def _load() -> None:
    # Import for side effects: each module registers its queries.
    from . import (  # noqa: F401
        q_blend,
        q_context,
        q_drift,
        q_encode,
        q_folds,
        q_history,
        q_misc,
        q_models,
        q_profile,
        q_scalar,
        q_sinks,
        q_stream,
    )


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(sorted(_QUERIES.items()))


def all_sql() -> dict[str, str]:
    _load()
    return dict(sorted(_SQL.items()))
