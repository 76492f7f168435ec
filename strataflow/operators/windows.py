"""Window functions: frames, null treatment, and FILTER or DISTINCT inside OVER, which Spark rejects."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .relational import keys


def over(by: list[str] | None = None, order: list[str | Column] | None = None) -> WindowSpec:
    """A window with the engine's null order; without by all rows are one partition."""
    w = Window.partitionBy(*(by or []))
    return w.orderBy(*keys(*order)) if order else w


def rows(w: WindowSpec, start: int | None, end: int | None) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding if start is None else start, Window.unboundedFollowing if end is None else end)


def filtered(aggregate, value: Column, condition: Column, w: WindowSpec) -> Column:
    """agg(value) FILTER (WHERE condition) OVER w."""
    return aggregate(F.when(condition, value)).over(w)


def count_distinct(value: Column, w: WindowSpec) -> Column:
    """count(DISTINCT value) OVER w."""
    return F.size(F.collect_set(value).over(w)).cast("long")


def count_distinct_whole(value: Column, by: list[str]) -> Column:
    """count(DISTINCT value) OVER (PARTITION BY by): ranks from both ends, so that no row carries a set of values."""
    w = Window.partitionBy(*by)
    both = F.dense_rank().over(w.orderBy(value.asc_nulls_first())) + F.dense_rank().over(w.orderBy(value.desc_nulls_last()))
    return (both - 1 - F.max(value.isNull().cast("int")).over(w)).cast("long")


def lag(value: str, n: int = 1, default: object = None, ignore_nulls: bool = False) -> str:
    """As SQL text, which has IGNORE NULLS."""
    tail = " ignore nulls" if ignore_nulls else ""
    return f"lag({value}, {n}, {'null' if default is None else default}){tail}"
