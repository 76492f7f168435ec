"""Table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .relational import project_set


def unnest(df: DataFrame, keep: list[str], **arrays: Column) -> DataFrame:
    """Arrays side by side, shorter ones filled with nulls; nested arrays are flattened whole before."""
    return project_set(df, keep, **arrays)


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1) -> DataFrame:
    """Integers from start to stop, both ends taken; made by the tasks, not the driver."""
    if step == 0:
        raise ValueError("the step must not be zero")
    end = stop + (1 if step > 0 else -1)
    return spark.range(start, end, step).toDF("generate_series")


def generate_times(spark: SparkSession, start: str, stop: str, step: str) -> DataFrame:
    """Timestamps from start to stop by an interval."""
    return spark.sql(f"select explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{stop}', interval {step})) as generate_series")


def generate_subscripts(a: Column, reverse: bool = False) -> Column:
    """An array of the places of a, for project_set."""
    places = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a))).otherwise(F.array().cast("array<int>"))
    return F.reverse(places) if reverse else places


def regexp_matches(s: Column, pattern: str, every: bool = False) -> Column:
    """An array of text[] (groups, or the match if there are none), for the first match or every one."""
    import re

    groups = re.compile(pattern).groups
    got = [F.regexp_extract_all(s, F.lit(pattern), F.lit(i)) for i in (range(1, groups + 1) if groups else [0])]
    rows = F.transform(F.sequence(F.lit(0), F.size(got[0]) - 1), lambda i: F.array(*[F.get(g, i) for g in got]))
    rows = F.when(F.size(got[0]) > 0, rows).otherwise(F.array().cast("array<array<string>>"))
    return rows if every else F.slice(rows, 1, 1)


def expand_array(df: DataFrame, keep: list[str], a: Column) -> DataFrame:
    """(x, n): elements and their places from 1."""
    return df.select(*keep, F.posexplode(a).alias("_n", "x")).select(*keep, "x", (F.col("_n") + 1).alias("n"))


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def empty_row(spark: SparkSession) -> DataFrame:
    return spark.sql("select 1 as _").drop("_")


def keywords(spark: SparkSession) -> DataFrame:
    return spark.sql("select keyword as word, reserved from sql_keywords()")


#: Fixed values.
SUMMITS = [
    ("Mont Blanc", 4808, "FR/IT", 6.8652, 45.8326), ("Monte Rosa", 4634, "CH/IT", 7.8668, 45.9369), ("Dom", 4545, "CH", 7.8589, 46.0940), ("Weisshorn", 4506, "CH", 7.7161, 46.1013), ("Matterhorn", 4478, "CH/IT", 7.6585, 45.9766),
]


def summits(spark: SparkSession) -> DataFrame:
    """A small static table of mountains."""
    return spark.createDataFrame(SUMMITS, "mountain string, height int, country string, lon double, lat double")
