"""Structured Streaming forms of the time-bucket queries, file ingestion and keyed upserts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, folder: str, schema: StructType | str, format: str = "parquet", files_each: int = 1) -> DataFrame:
    """COPY FROM that keeps running: files that arrive in folder."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", files_each).load(folder)


def tumbling(stream: DataFrame, ts: str, width: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    """date_bin group-by over a stream; rows later than late behind the latest are left out."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width), *by).agg(*aggs).withColumn("bucket", F.col("window.start")).drop("window")


def sliding(stream: DataFrame, ts: str, width: str, step: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", width, step), *by).agg(*aggs).withColumn("bucket", F.col("window.start")).drop("window")


def sessions(stream: DataFrame, ts: str, gap: str, late: str, by: list[str], *aggs: Column) -> DataFrame:
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.session_window("_ts", gap), *by).agg(*aggs).withColumn("start", F.col("session_window.start")).withColumn("stop", F.col("session_window.end")).drop("session_window")


def once_each(stream: DataFrame, ts: str, key: list[str], late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late).dropDuplicatesWithinWatermark(key).drop("_ts")


def upsert(stream: DataFrame, path: str, key: list[str], newest: str, checkpoint: str, buckets: int = 0) -> StreamingQuery:
    """ON CONFLICT UPDATE over a stream: each batch replaces the rows of its keys in the table at path. Of a batch's rows of
    one key the newest counts (of equally new ones that of the least hash). With buckets the table is partitioned by a
    hash of the key (column _bucket), and a batch rewrites only the partitions that it touches; without, all of it."""
    from pyspark.sql import Window as W

    from ..operators.dml import replace_table

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        order = W.partitionBy(*key).orderBy(F.col(newest).desc(), F.xxhash64(*batch.columns))
        last = batch.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
        if buckets:
            last = last.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        new = last
        try:
            old = spark.read.parquet(path)
            if buckets:
                touched = [r[0] for r in last.select("_bucket").distinct().collect()]  # at most buckets numbers
                old = old.where(F.col("_bucket").isin(touched))
            new = old.join(last.select(*key), key, "left_anti").select(*last.columns).unionByName(last)
        except AnalysisException as e:  # the first batch finds no table
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        if buckets:
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
        else:
            replace_table(new, path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is there into a table in the driver's memory; for tests and small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def to_files(df: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Runs a streaming query over all that is there into Parquet files under path; the driver gathers nothing. In
    complete mode the last batch's folder is the result, else all batches' folders are."""
    done: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        at = f"{path}/batch-{number}"
        batch.write.mode("overwrite").parquet(at)
        done.append(at)

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    found = done[-1:] if mode == "complete" else done
    return df.sparkSession.read.schema(df.schema).parquet(*found) if found else df.sparkSession.createDataFrame([], df.schema)
