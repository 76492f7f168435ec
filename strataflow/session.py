"""One place that builds a session: UTC, ANSI errors, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", name: str = "strataflow", **more: str) -> SparkSession:
    """A session with SETTINGS; more overrides them (dots of a key written as double underscores)."""
    b = SparkSession.builder.master(master).appName(name)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
