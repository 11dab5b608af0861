"""Registry of the engine's queries and of the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "class_bucket_counts"
_MODULES = ("profile_queries", "geometry_queries", "rule_queries", "join_queries", "matching_queries", "aggregate_queries", "sampling_queries", "analysis_queries", "audit_queries", "text_queries", "stream_queries", "guard_queries", "context_queries", "mask_queries", "evidence_queries", "evaluation_queries")
_FOUND: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its oracle if SQL has one."""

    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def _load() -> None:
    for module in _MODULES:
        import_module(f"marlstone.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return {name: f for name, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _FOUND.items() if sql is not None}
