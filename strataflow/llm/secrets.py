"""Secrets in texts, by an incremental ledger of blobs.

Every text is a blob named by its SHA-256. Only pairs of blob and rule version that the ledger lacks are
scanned, each distinct blob once; findings are then joined back to every path that holds the blob. A ledger can live
in a folder (update): each call adds the entries of the blobs it scanned, and the next one reads them all.

Runs in the JVM. Null texts count as empty; empty texts have no findings; an empty table gives no rows; long texts are
scanned whole; findings of several kinds at one place are all listed, by start, then kind; rows that share a text
share its findings; equal rows each keep their own result; other columns of the input are not touched."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, path_exists
from .spans import SPAN, Rule, found

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
RULES = [
    Rule("assign", ASSIGN, "(?i)pass|secret|token|api", lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}+", "AKIA"),
    Rule("hex", r"[0-9a-f]{16,}+"),
    Rule("private_key", r"-----BEGIN(?:\x20[A-Z0-9]{1,20}){0,4}\x20PRIVATE\x20KEY-----", "-----BEGIN"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", "eyJ"),
]
BASE = 3
KINDS = [r.kind for r in RULES]
RULE_VERSION = "1"


def scan(docs: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ledger): findings has (path, blob, secrets array<SPAN>) for every row of docs; ledger has
    (blob, rule_version, secrets) for the blobs of docs, those scanned now and those taken from the given ledger.

    Digests are counted first. A text that no other row has is scanned where it lies; only texts that several rows share
    meet by blob, combined before the shuffle, so that one held by a third of all rows is sent once by each task. While
    the blobs that are shared or known are few, they are looked up by broadcast and no other text is shuffled."""
    rows = docs.select(F.col(path), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    sums, _ = cut(rows.groupBy("blob").agg((F.count("*") > 1).alias("shared")), "digests")
    skipped, shared = sums.where("shared").select("blob"), sums.where("shared").select("blob")
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == RULE_VERSION).select("blob", "rule_version", F.col("secrets").cast(f"array<{SPAN}>").alias("secrets")).dropDuplicates(["blob"])
        seen, _ = cut(sums.join(known, "blob", "left_semi").select("blob"), "seen")
        skipped, shared = skipped.union(seen).distinct(), shared.join(seen, "blob", "left_anti")
    alone = rows.join(maybe_broadcast(skipped), "blob", "left_anti").select("blob", "text")
    common = rows.join(maybe_broadcast(shared), "blob", "left_semi").groupBy("blob").agg(F.any_value("text").alias("text"))
    spans = F.array_sort(F.concat(*[found(F.col("text"), r, i) for i, r in enumerate(RULES)]))
    entries = alone.unionByName(common).select("blob", F.lit(RULE_VERSION).alias("rule_version"), spans.alias("secrets"))
    if ledger is not None:
        entries = entries.unionByName(known.join(seen, "blob", "left_semi"))
    entries, _ = cut(entries, "entries")
    return rows.select(path, "blob").join(entries.select("blob", "secrets"), "blob").select(path, "blob", "secrets"), entries


def update(docs: DataFrame, folder: str, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Findings (path, blob, secrets) of docs, with the ledger in folder: it need not exist; what it lacks is scanned and
    added. Batches written by runs that overlap may repeat an entry; one of the equal ones counts."""
    spark = docs.sparkSession
    known = spark.read.schema(f"blob string, rule_version string, secrets array<{SPAN}>").parquet(folder) if path_exists(spark, folder) else None
    findings, fresh = scan(docs, path, text, known)
    new = fresh if known is None else fresh.join(known.where(F.col("rule_version") == RULE_VERSION).select("blob"), "blob", "left_anti").select(*fresh.columns)
    new.write.mode("append").parquet(folder)
    return findings
