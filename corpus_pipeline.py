"""A corpus pipeline: five stages, each a corpus operator at work on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Between stages the rows are written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.llm import decontam, langid, mixing, pii, simhash
from strataflow.llm.common import WRITTEN, cut, sweep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.dedupe(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item. One leaked item is enough to spoil a score, so the stage is
    stricter than the report of op9, which calls documents with two or more items contaminated."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least_items=1)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by marks; n_chars follows the text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents taken into the mix, with n_copies: how often each is taken."""
    return mixing.mix(docs, keep=docs.columns)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("PII", personal_data),
    ("mixing sources to target weights", mixed),
]
#: Models and hashes that SQL does not have; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Once a stage's rows are written, all that was written before them in this run is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(WRITTEN)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = cut(docs, "stage")
            sweep(spark, before, path)
    return docs
