"""Sorting, limits, set operations and joins with the engine's null rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys(*by: str | Column) -> list[Column]:
    """Sort keys: 'x' ascending with nulls last, '-x' descending with nulls first; Columns are taken as they are."""
    return [k if isinstance(k, Column) else F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_last() for k in by]


def order(df: DataFrame, *by: str | Column) -> DataFrame:
    return df.orderBy(*keys(*by))


def top(df: DataFrame, by: list[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY with LIMIT and OFFSET: every task keeps limit + offset rows, and only those are merged."""
    out = df.orderBy(*keys(*by))
    return out.offset(offset).limit(limit) if offset else out.limit(limit)


def union(*parts: DataFrame, distinct: bool = False) -> DataFrame:
    """By position; object columns of different shapes are brought to one by name."""
    out = reduce(lambda a, b: a.unionByName(b.toDF(*a.columns), allowMissingColumns=True), parts)
    return out.distinct() if distinct else out


def distinct_limit(df: DataFrame, limit: int) -> DataFrame:
    """SELECT DISTINCT .. LIMIT: each task stops distinguishing once it has limit values."""
    return df.distinct().limit(limit)


def filter_(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true (not unknown)."""
    return df.where(condition)


def ignore3vl(condition: Column) -> Column:
    """Unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def project_set(df: DataFrame, keep: list[str], **sets: Column) -> DataFrame:
    """Set-returning expressions (arrays) in a select list: they advance in lock-step, shorter ones give nulls.
    A null array counts as an empty one. Rows whose sets are all empty go."""
    zipped = F.arrays_zip(*[F.coalesce(v, F.array()).alias(k) for k, v in sets.items()])
    return df.select(*keep, F.explode(zipped).alias("_set")).select(*keep, *[F.col("_set").getField(k).alias(k) for k in sets])


#: Bytes up to which Catalyst's size estimate of a side is trusted for a broadcast without asking for it.
SMALL = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size, from file sizes or statistics."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(large: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi join that filters the large side by the keys of the small one: broadcast if the estimate is small
    enough, else left to the planner with its runtime filters."""
    return large.join(F.broadcast(small) if estimated_bytes(small) <= SMALL else small, on, how)


def semi(a: DataFrame, b: DataFrame, on: object) -> DataFrame:
    return a.join(b, on, "left_semi")


def anti(a: DataFrame, b: DataFrame, on: object) -> DataFrame:
    return a.join(b, on, "left_anti")


def not_in(a: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """NOT IN (subquery): nothing is kept if values holds a null, null keys are kept only if values is empty. The planner's
    own NOT IN broadcasts the values however many there are; here they are joined, and one row of counts is broadcast."""
    v = values.toDF("_v")
    row = v.agg(F.count("*").alias("_n"), F.count("_v").alias("_known"))
    left = a.withColumn("_key", F.expr(key)).join(v.where("_v is not null").distinct(), F.col("_key") == F.col("_v"), "left_anti")
    return left.crossJoin(F.broadcast(row)).where("_n = 0 or (_known = _n and _key is not null)").select(*a.columns)  # one row


NEGATED = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def any_of(df: DataFrame, key: Column, op: str, values: DataFrame, name: str) -> DataFrame:
    """df with name: key op ANY (subquery), unknown where no known value decides it and a null might. Only an extreme and
    the number of nulls count, from one aggregated row; for = the values are joined."""
    v = values.toDF("_v")
    row = v.agg(F.count("*").alias("_n"), F.count("_v").alias("_known"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))
    out, lo, hi = df.withColumn("_key", key), F.col("_min"), F.col("_max")
    if op == "=":
        out = out.join(v.where("_v is not null").distinct().withColumn("_hit", F.lit(True)), F.col("_key") == F.col("_v"), "left").drop("_v")
    k = F.col("_key")
    hit = {"=": lambda: F.col("_hit"), "<>": lambda: (k != lo) | (k != hi), ">": lambda: k > lo, ">=": lambda: k >= lo, "<": lambda: k < hi, "<=": lambda: k <= hi}[op]()
    told = F.when(F.col("_n") == 0, False).when(hit, True).when(k.isNull() | (F.col("_known") < F.col("_n")), F.lit(None).cast("boolean")).otherwise(False)
    return out.crossJoin(F.broadcast(row)).select(*df.columns, told.alias(name))  # one row


def all_of(df: DataFrame, key: Column, op: str, values: DataFrame, name: str) -> DataFrame:
    """df with name: key op ALL (subquery), which is not (key negated-op ANY)."""
    out = any_of(df, key, NEGATED[op], values, name)
    return out.select(*df.columns, (~F.col(name)).alias(name))


def compare_all(df: DataFrame, key: Column, op: str, values: DataFrame) -> DataFrame:
    """WHERE key op ALL (subquery)."""
    return all_of(df, key, op, values, "_told").where("_told").select(*df.columns)


def compare_any(df: DataFrame, key: Column, op: str, values: DataFrame) -> DataFrame:
    """WHERE key op ANY (subquery)."""
    return any_of(df, key, op, values, "_told").where("_told").select(*df.columns)
