"""Queries by name, with the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.plans.projection import SQL

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _with_projection(sql: str) -> str:
    """sql after the projection's tables, whether or not it has tables of its own."""
    own = sql.lstrip().removeprefix("WITH")
    recursive = "RECURSIVE " if "reach(" in sql or "walk(" in sql else ""
    return f"WITH {recursive}{SQL}{', ' if own != sql.lstrip() else ' '}{own}"


def query(sql: str | None = None, graph_tables: bool = True):
    """Registers a query under its function's name; sql may use the projection's tables."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = _with_projection(sql) if graph_tables else sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
