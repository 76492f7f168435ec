"""Vectors: similarity and exact nearest neighbours, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """1 / (1 + squared Euclidean distance)."""
    return 1 / (1 + squared_distance(a, b))


def knn(rows: DataFrame, vector: str, query: list[float], k: int, *tie: str) -> DataFrame:
    """The k rows nearest to query with their _score; each task keeps k rows, and only those meet."""
    target = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("_score", similarity(F.col(vector), target)).orderBy(F.col("_score").desc(), *tie).limit(k)
