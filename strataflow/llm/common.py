"""Helpers shared by the corpus operators: cutting lineage, components of a graph, row counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of a few narrow columns may be broadcast; callers count first.
BROADCAST_ROWS = 500_000
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (only where that is unset) a local one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.strataflow.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strataflow-")
        spark.conf.set("spark.strataflow.scratch", path)
    return path.rstrip("/")


def sweep(spark: SparkSession, since: int = 0, keep: str | None = None) -> int:
    """Deletes the tables that cut() wrote in this process, for use once the results that read them are stored; returns
    their number. since: only those after the first so many; keep: one that stays. An external retention rule on the
    shared folder does the same for processes that were lost."""
    gone = [p for p in WRITTEN[since:] if p != keep]
    for p in gone:
        delete_path(spark, p)
        WRITTEN.remove(p)
    return len(gone)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cut(df: DataFrame, name: str = "cut") -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it again: the lineage ends there and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have (names are told apart without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value), value being computed once for each row; a plain reference would be computed anew for each
    element of the arrays made from it."""
    return F.get(F.transform(F.array(value), body), 0)


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most limit rows (or, with a weight, such as the length of an
    array in a row, at most that in all); else as it is, for a shuffled join."""
    n = df.limit(limit + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if n <= limit else df


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges: a row (node, component) for every node of an edge,
    component being the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each step is one aggregate
    (a minimum per node, partially aggregated, so that hubs do not gather) and one join. Every round
    is written to the shared folder. Null ends and loops are ignored; no edges give no rows."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs, path = cut(pairs, "edges")
    seen = None
    for _ in range(most_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: of each node, its smaller neighbours and itself go to the smallest
        small = large.where("u <> v").distinct()
        least = small.groupBy("u").agg(F.min("v").alias("m"))
        joined = small.join(least, "u")
        after = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after, new_path = cut(after.where("u <> v").distinct(), "edges")
        now = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        delete_path(spark, path)
        WRITTEN.remove(path)
        pairs, path = after, new_path
        if seen == (now.n, now.s):
            break
        seen = (now.n, now.s)
    else:
        raise RuntimeError("the components did not settle")
    stars = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
