"""Names of the queries with the callables and the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its DuckDB oracle if there is one."""

    def register(fn: Query) -> Query:
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn

    return register


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
