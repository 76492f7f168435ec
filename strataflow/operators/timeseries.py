"""Time buckets over rows with a timestamp, with gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import date_bin


def binned(df: DataFrame, ts: str, width: str, by: list[str], *aggs: Column, origin: str = "1970-01-01 00:00:00") -> DataFrame:
    """Aggregates by bucket of width and by the columns by."""
    return df.groupBy(*by, date_bin(width, F.col(ts), origin).alias("bucket")).agg(*aggs)


def fill_gaps(rows: DataFrame, by: list[str], width: str, fill: dict[str, object]) -> DataFrame:
    """rows (by, bucket, ..) with a row for every bucket between a group's first and last; those added get fill. Null keys
    are a group of their own; rows as they were, with their nulls, and rows without a bucket stay."""
    whole = rows.withColumn("_here", F.lit(True))
    ends = rows.groupBy(*by).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    every = ends.where("_lo is not null").select(*[F.col(c).alias(f"_g_{c}") for c in by], F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {width}"))).alias("_bucket"))
    same = F.col("bucket") == F.col("_bucket")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    joined = every.join(whole.where("bucket is not null"), same, "left")
    source = {**{c: F.col(f"_g_{c}") for c in by}, "bucket": F.col("_bucket")}
    added = lambda c: F.when(F.col("_here"), F.col(c)).otherwise(F.lit(fill[c]).cast(rows.schema[c].dataType)) if c in fill else F.col(c)
    out = joined.select(*[source[c].alias(c) if c in source else added(c).alias(c) for c in rows.columns])
    return out.unionByName(rows.where("bucket is null"))
