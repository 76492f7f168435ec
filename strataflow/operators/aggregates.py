"""Aggregates that Spark lacks or defines differently."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def variance(x: Column) -> Column:
    """Of the population."""
    return F.var_pop(x)


def array_agg(x: Column) -> Column:
    """Keeps nulls; in no particular order."""
    return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda s: s["x"])


def array_agg_ordered(x: Column, *by: Column) -> Column:
    """Keeps nulls; sorted by other expressions."""
    keyed = F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], x.alias("x"))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["x"])


def collect_set(x: Column) -> Column:
    """Distinct values without nulls, sorted."""
    return F.array_sort(F.collect_set(x))


def geometric_mean(x: Column) -> Column:
    """Null if any value is not positive, rather than without that value."""
    return F.when(F.min(x) > 0, F.exp(F.avg(F.ln(x))))


def string_agg(x: Column, sep: str, *by: Column) -> Column:
    """Joined texts without nulls, sorted by the given expressions (by the text itself if there are none)."""
    return F.array_join(F.filter(array_agg_ordered(x, *(by or (x,))), lambda v: v.isNotNull()), sep)


def any_value(x: Column) -> Column:
    return F.any_value(x, F.lit(True))


def max_by(x: Column, by: Column) -> Column:
    """x, a whole number, of the row with the largest by; of several such rows the least x, whatever order they come in.
    Rows in which either is null don't count."""
    return F.max_by(x, F.when(x.isNotNull() & by.isNotNull(), F.struct(by.alias("by"), F.bitwise_not(x).alias("x"))))  # ~x falls as x rises and fits its type


def min_by(x: Column, by: Column) -> Column:
    """Like max_by, of the row with the least by."""
    return F.min_by(x, F.when(x.isNotNull() & by.isNotNull(), F.struct(by.alias("by"), x.alias("x"))))


def percentile(x: Column, p: float | list[float]) -> Column:
    """Interpolated; exact. A group's different values are held in memory: percentiles() sorts them with spilling instead,
    percentile_sketch() is approximate in bounded memory."""
    return F.percentile(x, F.array(*[F.lit(v) for v in p]) if isinstance(p, list) else F.lit(p))


def percentiles(df: DataFrame, by: list[str], x: str, ps: dict[str, float]) -> DataFrame:
    """(by, one column for each of ps): interpolated and exact like percentile(). Equal values are counted before they are
    sent, and a group's different ones are put in order by a sort that may spill, so that none has to fit in memory."""
    from pyspark.sql import Window as W

    known = df.groupBy(*by, x).agg(F.count("*").alias("_n")).where(F.col(x).isNotNull())
    w = W.partitionBy(*by)
    placed = known.withColumn("_upto", F.sum("_n").over(w.orderBy(x))).withColumn("_all", F.sum("_n").over(w))
    at = {name: p * (F.col("_all") - 1) for name, p in ps.items()}
    ends = {f"{end}_{name}": F.min(F.when(F.col("_upto") > cut(place), F.col(x))) for name, place in at.items() for end, cut in (("_lo", F.floor), ("_hi", F.ceil))}
    got = placed.groupBy(*by).agg(F.max("_all").alias("_all"), *[v.alias(k) for k, v in ends.items()])
    return got.select(*by, *[(F.col(f"_lo_{k}") + (at[k] - F.floor(at[k])) * (F.col(f"_hi_{k}") - F.col(f"_lo_{k}"))).alias(k) for k in ps])


def percentile_sketch(x: Column, p: float | list[float], accuracy: int = 10_000) -> Column:
    """Approximate, from mergeable summaries of bounded size."""
    return F.percentile_approx(x, p, accuracy)


def hyperloglog_distinct(x: Column, precision: int = 14) -> Column:
    """Approximate number of distinct values; precision p gives 2^p registers."""
    return F.approx_count_distinct(x, 1.04 / 2 ** (precision / 2))


def top_k(df: DataFrame, by: list[str], x: str, k: int) -> DataFrame:
    """The k most frequent values of x by group (ties by value), exact: counts are combined before they are sent."""
    from pyspark.sql import Window as W

    counts = df.groupBy(*by, x).agg(F.count("*").alias("frequency")).where(F.col(x).isNotNull())
    ranked = counts.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(F.col("frequency").desc(), x)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def topk_sketch(x: Column, k: int = 8, capacity: int = 8192) -> Column:
    """Approximate frequent items from a sketch of bounded size. Of more values than its capacity it returns only those that
    are surely frequent, which may be none: top_sketched() deals them to several sketches."""
    return F.call_function("approx_top_k", x, F.lit(k), F.lit(capacity))


def top_sketched(df: DataFrame, x: str, k: int, capacity: int = 8192) -> DataFrame:
    """(item, count): the k most frequent values of x (null is one of them; ties by value), exact: values are dealt by hash to
    so many sketches of bounded size that each stays half empty, and a sketch that takes all of its values counts exactly.
    How many there are is estimated (by 1 %); should a sketch be too small all the same, that is an error, not another result."""
    values = df.agg(hyperloglog_distinct(F.col(x)).alias("n")).first().n
    parts = max(-(-2 * values // capacity), 1)
    dealt = df.groupBy(F.pmod(F.xxhash64(x), F.lit(parts)).alias("_part")).agg(F.call_function("approx_top_k_accumulate", F.col(x), F.lit(capacity)).alias("_sketch"))
    dropped = F.substring("_sketch.sketch", 25, 8)  # by how much counts may be too high; shorter sketches hold no values
    exact = (F.length(dropped) == 0) | (dropped == F.lit(bytes(8)))
    items = F.when(exact, F.call_function("approx_top_k_estimate", "_sketch", F.lit(capacity))).otherwise(F.raise_error(F.lit("a sketch had to drop values")))
    return dealt.select(F.inline(items)).orderBy(F.desc("count"), F.col("item").asc_nulls_last()).limit(k)


def avg_timestamp(ts: Column) -> Column:
    """Milliseconds since 1970, as a double."""
    return F.avg(F.unix_millis(ts.cast("timestamp")).cast("double"))


def avg_numeric(x: Column, digits: int = 12) -> Column:
    """The average of a decimal with so many digits after the point: Spark alone keeps four more than x has, too few to round again."""
    return F.avg(x.cast(f"decimal(24,{digits})"))


def sum_real(x: Column) -> Column:
    """A real's sum: added up as doubles, returned as a real."""
    return F.sum(x.cast("double")).cast("float")


def sum_seconds(x: Column) -> Column:
    """Of exact intervals, each taken to whole seconds towards zero: Spark's own sum of intervals overflows at 292,271 years,
    which 300,000 rows of a year reach."""
    return F.sum(x.cast("interval second").cast("decimal(19,6)").cast("long"))


def sum_whole(x: Column) -> Column:
    """Of whole numbers, none of whose parts overflows: only a result has to fit what it is cast to."""
    return F.sum(x.cast("decimal(19,0)"))


def sum_intervals(x: Column) -> Column:
    """Of mixed intervals, part by part."""
    return F.struct(F.sum(x["months"]).alias("months"), sum_whole(x["micros"]).cast("long").alias("micros"))


def avg_intervals(x: Column) -> Column:
    """Of mixed intervals: months and exact time are averaged apart; what is left of a month counts as days of a month of 30."""
    n, months = F.nullif(F.count(x["months"]), F.lit(0)), F.sum(x["months"])
    whole = F.floor(months / n)
    rest = (months - whole * n) / n * 30 * 86_400_000_000
    return F.struct(whole.alias("months"), F.floor(sum_whole(x["micros"]).cast("double") / n + rest).cast("long").alias("micros"))


def sum_stable(x: Column, digits: int = 12) -> Column:
    """A sum of doubles that does not depend on their order: each is taken to so many digits after the point and added up
    exactly, where the compensated sum of one machine bounds the error but still depends on the order."""
    return F.sum(x.cast(f"decimal(38,{digits})")).cast("double")


def keep_largest_triangles(x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Places that largest-triangle-three-buckets keeps of points sorted by x (Steinarsson, 2013)."""
    n = len(x)
    if most <= 0 or n <= most:
        return np.arange(n)
    if most < 3:
        return np.array([0, n - 1])[:most]
    width, kept = (n - 2) / (most - 2), [0]
    for i in range(most - 2):
        lo, hi = int(i * width) + 1, int((i + 1) * width) + 1
        nxt = slice(hi, max(min(int((i + 2) * width) + 1, n), hi + 1))
        mx, my, a = x[nxt].mean(), y[nxt].mean(), kept[-1]
        size = np.abs((x[a] - mx) * (y[lo:hi] - y[a]) - (x[a] - x[lo:hi]) * (my - y[a]))
        kept.append(lo + int(np.argmax(size)))
    return np.array([*kept, n - 1])


def lttb(df: DataFrame, by: list[str], ts: str, y: str, most: int) -> DataFrame:
    """Downsampled series by group: (by, ts, y) of the points kept. A group is one series and has to fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[ts, y]).sort_values(ts, kind="stable")
        at = pdf[ts].astype("int64").to_numpy(dtype=float)
        return pdf.iloc[keep_largest_triangles(at, pdf[y].to_numpy(dtype=float), most)]

    rows = df.select(*by, ts, y)
    return rows.groupBy(*by).applyInPandas(run, rows.schema)
