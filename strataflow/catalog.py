"""Lazy loaders of tables in a folder of parquet files, and temporary views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Tables:
    """tables.orders reads orders.parquet when asked for; nothing is read before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        """Register names (all tables if none) as temporary views, for spark.sql."""
        for n in names or TABLES:
            getattr(self, n).createOrReplaceTempView(n)
        return self.spark
