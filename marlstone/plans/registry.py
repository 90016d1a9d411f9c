"""The queries of the timed-text operators, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from marlstone.plans import queries_files, queries_order, queries_policy, queries_rows, queries_seams, queries_stages, queries_text  # noqa: F401


def queries() -> dict[str, Query]:
    """Name to a function of (spark, sf_dir)."""
    _load()
    return dict(sorted(_QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL over views named as the tables."""
    _load()
    return dict(sorted(_SQL.items()))
