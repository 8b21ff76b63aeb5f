"""The registered core queries and their independent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "change_classification"
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""
    def add(function: Query) -> Query:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = sql
        return function

    return add


def _load() -> None:
    from tidemark.plans import change_queries, run_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
