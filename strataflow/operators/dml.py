"""Changes to tables of immutable files: each returns the table's new rows, or writes them beside and swaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def one_each(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: of different ones that of the least hash."""
    rest = [c for c in rows.columns if c not in key]
    if not rest:
        return rows.distinct()
    picked = rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("_row"))
    return picked.select(*[F.col(c) if c in key else F.col("_row").getField(c).alias(c) for c in rows.columns])


def insert_on_conflict(target: DataFrame, rows: DataFrame, key: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """INSERT .. ON CONFLICT: rows whose key exists are dropped (update None), or change the named columns by expressions
    over target's columns and excluded (a struct of the new row). Of rows with equal keys one counts, the same whatever
    the order of rows: that of the least hash."""
    fresh = one_each(rows, key)
    new = fresh.join(target.select(*key), key, "left_anti").select(*target.columns)
    if not update:
        return target.unionByName(new)
    other = fresh.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.struct(*fresh.columns).alias("excluded"))
    joined = target.join(other, [F.col(k) == F.col(f"_k_{k}") for k in key], "left")
    changed = joined.select(*[F.when(F.col("excluded").isNotNull(), update[c]).otherwise(F.col(c)).alias(c) if c in update else F.col(c) for c in target.columns])
    return changed.unionByName(new)


def update(target: DataFrame, where: Column, assign: dict[str, Column]) -> DataFrame:
    """UPDATE .. SET .. WHERE: rows for which where is true get the new values."""
    return target.select(*[F.when(where, assign[c]).otherwise(F.col(c)).alias(c) if c in assign else F.col(c) for c in target.columns])


def delete(target: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows for which where is false or unknown stay."""
    return target.where(~F.coalesce(where, F.lit(False)))


def update_returning(target: DataFrame, where: Column, assign: dict[str, Column], *out: str | Column) -> DataFrame:
    """RETURNING of an UPDATE: expressions over the changed rows as they are afterwards (all columns if none are given)."""
    return update(target.where(where), F.lit(True), assign).select(*(out or target.columns))


def insert_returning(target: DataFrame, rows: DataFrame, key: list[str], *out: str | Column) -> DataFrame:
    """RETURNING of an INSERT .. ON CONFLICT DO NOTHING: expressions over the rows that went in."""
    return one_each(rows, key).join(target.select(*key), key, "left_anti").select(*target.columns).select(*(out or target.columns))


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write df over the table at path, although df reads it: first beside it, then by renames. Between the two renames
    readers find no table, and a crash there leaves it beside (recover() puts it back); where that matters, or where
    renames are not atomic, as in object stores, use put_version() and read_version()."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    fs = at.getFileSystem(conf)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> bool:
    """After a crash of replace_table(): puts the old table back if there is none at path."""
    at, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".old"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return not fs.exists(at) and fs.exists(old) and fs.rename(old, at)


def _versions(spark: SparkSession, root: str) -> tuple[object, list[int]]:
    """The file system of root and the numbers of the versions that are whole: those with Spark's mark of success."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    folders = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    done = [p for p in folders if p.getName().startswith("v") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return fs, sorted(int(p.getName()[1:]) for p in done)


def put_version(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write df as the next version of the table at root, in a folder of its own that counts once it is whole (Spark writes
    its mark last), so that readers always find a table and nothing is renamed. Older versions beyond keep go."""
    spark = df.sparkSession
    fs, known = _versions(spark, root)
    number = known[-1] + 1 if known else 0
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{root}/v{number}")
    for old in known[: max(len(known) + 1 - keep, 0)]:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/v{old}"), True)
    return number


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version of the table at root."""
    _, known = _versions(spark, root)
    if not known:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/v{known[-1]}")


def delete_partitions(spark: SparkSession, path: str, column: str, values: list) -> None:
    """DELETE by partition value: folders go, no file is rewritten."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for v in values:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={v}")
        p.getFileSystem(conf).delete(p, True)


def optimize(spark: SparkSession, path: str, files: int) -> None:
    """OPTIMIZE TABLE: compacts to a number of files."""
    replace_table(spark.read.parquet(path).repartition(files), path)


def create_table_as(df: DataFrame, name: str, bucket_by: list[str] | None = None, buckets: int = 8, partition_by: list[str] | None = None, path: str | None = None) -> None:
    """CREATE TABLE AS, clustered (bucketed: joins and aggregates on these columns need no shuffle) and partitioned."""
    w = df.write.mode("overwrite").format("parquet")
    w = w.bucketBy(buckets, *bucket_by).sortBy(*bucket_by) if bucket_by else w
    w = w.option("path", path) if path else w
    (w.partitionBy(*partition_by) if partition_by else w).saveAsTable(name)


def swap_tables(spark: SparkSession, a: str, b: str) -> None:
    for x, y in ((a, f"{a}_swapping"), (b, a), (f"{a}_swapping", b)):
        spark.sql(f"alter table {x} rename to {y}")


class Cursor:
    """DECLARE, FETCH, CLOSE: rows come partition by partition; going back is possible over what was fetched."""

    def __init__(self, df: DataFrame, scroll: bool = False):
        self.rows, self.seen, self.at, self.scroll = df.toLocalIterator(), [], 0, scroll

    def fetch(self, n: int = 1) -> list:
        if n < 0:
            if not self.scroll:
                raise ValueError("the cursor can't go back")
            lo = max(self.at + n, 0)
            out, self.at = self.seen[lo : self.at][::-1], lo
            return out
        out = []
        while len(out) < n:
            if self.at < len(self.seen):
                row = self.seen[self.at]
            elif (row := next(self.rows, None)) is None:
                break
            elif self.scroll:
                self.seen.append(row)
            out.append(row)
            self.at += 1 if self.scroll else 0
        return out

    def close(self) -> None:
        self.rows = iter(())
