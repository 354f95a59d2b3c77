"""Queries by name, and the SQL twin of each.

A query gets a function that loads a table or stand-in by name. Twins are DuckDB SQL in which braces name stand-ins.
Doubles are rounded half-even, and arrays are joined to texts, so that both engines give equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import load, with_sql

Query = Callable[[Callable[[str], DataFrame]], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its twin."""

    def add(f: Query) -> Query:
        if f.__name__ in _QUERIES:
            raise ValueError(f"a query {f.__name__} is there already")
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def _bound(f: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(lambda name: load(spark, sf_dir, name))


def _collect() -> None:
    from . import evidence_queries, function_queries, layout_queries, ledger_queries, search_queries, source_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _collect()
    return {name: _bound(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _collect()
    return {name: with_sql(sql) for name, sql in _SQL.items()}
