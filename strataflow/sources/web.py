"""COPY FROM of HTTP(S) addresses: tasks fetch them, one address each, and stream their lines."""

from __future__ import annotations

import urllib.request
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .files import BROKEN, csv_options, ddl, header_names, typed

CHUNK, LINES = 1 << 20, 10_000


def unpacked(parts: Iterable[bytes]) -> Iterator[bytes]:
    """What the gzip members of a stream hold, one after another; zeros may fill up behind them. A stream that ends
    inside a member is an error."""
    unpacker = None
    for part in parts:
        while part := part if unpacker else part.lstrip(b"\0"):
            unpacker = unpacker or zlib.decompressobj(31)
            yield unpacker.decompress(part)
            part = unpacker.unused_data
            if unpacker.eof:
                unpacker = None
    if unpacker:
        raise EOFError("the last gzip member is cut short")


def streamed(url: str, timeout: float) -> Iterator[bytes]:
    """The lines of what an address holds; gzip is told by its first bytes."""
    with urllib.request.urlopen(url, timeout=timeout) as f:
        first, rest = f.read(CHUNK), b""
        parts = chain([first], iter(lambda: f.read(CHUNK), b""))
        for part in unpacked(parts) if first[:2] == b"\x1f\x8b" else parts:
            *lines, rest = (rest + part).split(b"\n")
            yield from lines
        if rest:
            yield rest


def lines(spark: SparkSession, urls: list[str], timeout: float = 60.0) -> DataFrame:
    """(url, number, line) of all addresses, empty lines left out."""

    def run(batches):
        for b in batches:
            for url in b.column(0).to_pylist():
                held: list[tuple[int, str]] = []
                for n, line in enumerate(streamed(url, timeout)):
                    text = line.decode("utf-8", "replace").rstrip("\r")
                    if text:
                        held.append((n, text))
                    if len(held) == LINES:
                        yield pa.RecordBatch.from_arrays([pa.array([url] * len(held)), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held])], ["url", "number", "line"])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([url] * len(held)), pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held])], ["url", "number", "line"])

    return spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls))).mapInArrow(run, "url string, number long, line string")


def copy_from(spark: SparkSession, urls: list[str], schema: StructType | str, format: str = "json", *, header: bool = True, delimiter: str = ",", empty_string_as_null: bool = False, fail_fast: bool = False) -> DataFrame:
    """Rows of JSON lines or CSV without line breaks in its values; broken lines are left out, or fail the job with fail_fast.
    A header names the columns as in files.copy_from(); it is that of the first address, and others have to have the same."""
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = lines(spark, urls)
    if format != "csv":
        mode = {"mode": "FAILFAST" if fail_fast else "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
        out = rows.select(F.from_json("line", StructType([*schema.fields, StructField(BROKEN, StringType())]), mode).alias("r")).select("r.*")
        return out.where(F.col(BROKEN).isNull()).drop(BROKEN)
    names = schema.names
    if header:
        line = next(iter(streamed(urls[0], 60.0)), b"").decode("utf-8", "replace").rstrip("\r")
        names = header_names(line, delimiter)
        other = F.raise_error(F.concat("url", F.lit(" has another header: "), "line")).cast("boolean")
        rows = rows.where(F.when(F.col("number") > 0, True).when(F.col("line") == line, False).otherwise(other))
    texts = StructType([StructField(n, StringType()) for n in [*names, BROKEN]])
    found = rows.select(F.from_csv("line", ddl(texts), csv_options(delimiter)).alias("r")).select("r.*")
    return typed(found, names, schema, delimiter, header, empty_string_as_null, fail_fast).where(F.col(BROKEN).isNull()).drop(BROKEN)
