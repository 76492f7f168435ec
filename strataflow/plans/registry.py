"""The registry of queries: a name, a DataFrame builder, and the same query in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its own name; sql: the same rows from another engine."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def text(name: str, sql: str, oracle: str | None = None, *, tables: tuple[str, ...]) -> None:
    """Registers a query that is SQL text here as well; oracle: its form for the other engine, if it differs."""
    QUERIES[name] = lambda spark, folder: Tables(spark, folder).views(*tables).sql(sql)
    SQL[name] = oracle or sql
