"""COPY FROM and COPY TO: JSON lines and CSV, in and out."""

from __future__ import annotations

import csv

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

BROKEN = "_broken"


def copy_from(spark: SparkSession, paths: str | list[str], schema: StructType | str, format: str | None = None, *, header: bool = True, delimiter: str = ",", skip: int = 0, empty_string_as_null: bool = False, fail_fast: bool = False) -> DataFrame:
    """Rows of files or globs (gzip by name); format by the names' ending if it isn't given. Broken lines are left out,
    or fail the read with fail_fast. A CSV line is broken if a value does not have its column's type, if it has more values
    than the header, or, where there is none, fewer than the schema; values that it lacks are null, surplus ones left out.
    An empty value is an empty text (null with empty_string_as_null), and null in columns of other types. A header names the columns of its file, in any order: columns of the schema that it lacks are null, others are left
    out. All files of one read have the same header, else the read fails. Spaces around CSV values go. skip leaves out
    lines at the start of each file, before the header."""
    good, _ = _read(spark, paths, schema, format, header, delimiter, skip, empty_string_as_null, fail_fast)
    return good


def _read(spark, paths, schema, format, header, delimiter, skip, empty_string_as_null, fail_fast):
    paths = [paths] if isinstance(paths, str) else paths
    kind = format or ("csv" if all(".csv" in p for p in paths) else "json")
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    if kind == "csv":
        line = _line(spark, paths, skip) if header else None
        names = header_names(line, delimiter) if header else schema.names
        texts = StructType([StructField(n, StringType()) for n in [*names, BROKEN]])
        if skip:
            lines = _after_first_lines(spark, paths, skip, line).where("line <> ''")
            found = lines.select("_file", F.from_csv("line", ddl(texts), csv_options(delimiter)).alias("r")).select("_file", "r.*")
        else:
            # without pruning, so that a line is broken or not whatever columns are asked for
            reader = spark.read.schema(texts).options(**csv_options(delimiter), columnPruning="false", header=header, enforceSchema=not header)
            found = reader.csv(paths).withColumn("_file", F.col("_metadata.file_path"))
        rows = typed(found, names, schema, delimiter, header, empty_string_as_null, fail_fast)
    else:
        # lines first, for the reader of JSON refuses queries that ask for no column, such as counts
        whole = StructType([*schema.fields, StructField(BROKEN, StringType())])
        mode = {"mode": "FAILFAST" if fail_fast else "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
        lines = spark.read.text(paths).withColumn("_file", F.col("_metadata.file_path")).where("trim(value) <> ''")
        rows = lines.select(F.from_json("value", whole, mode).alias("r"), "_file").select("r.*", "_file")
    return rows.where(F.col(BROKEN).isNull()).drop(BROKEN, "_file"), rows


def csv_options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "columnNameOfCorruptRecord": BROKEN, "mode": "PERMISSIVE"}


def typed(rows: DataFrame, names: list[str], schema: StructType, delimiter: str, header: bool, empty_string_as_null: bool, fail_fast: bool) -> DataFrame:
    """The schema's columns of rows whose values were read as texts, with BROKEN (and _file): the line if it is broken, else
    null. BROKEN comes in as the line where the number of values is not that of names. How many there are is the place of
    a mark put behind such a line (of code points in private use); the mark is not met where there are more."""
    n, mark = len(names), "\ue000\ue000"
    again = F.from_csv(F.concat(F.col(BROKEN), F.lit(delimiter + mark)), ", ".join(f"_{i} string" for i in range(n)), csv_options(delimiter))
    size = F.when(F.col(BROKEN).isNull(), n).otherwise(F.array_position(F.array(*[again[f"_{i}"] for i in range(n)]), mark) - 1)
    # the reader refuses queries of no column but BROKEN; this least is always size
    rows = rows.withColumn("_size", F.least(size, F.coalesce(F.length(F.col(f"`{names[0]}`")), F.lit(0)) + n))
    odd = F.col("_size") < 0 if header else F.col("_size").between(0, n - 1)
    columns, bad = [], F.when(odd, F.coalesce(F.col(BROKEN), F.lit("")))
    for f in schema.fields:
        if f.name not in names:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text, i = F.col(f"`{f.name}`"), names.index(f.name)
        there = (F.col("_size") > i) | (F.col("_size") < 0)
        if isinstance(f.dataType, StringType):
            value = F.nullif(text, F.lit("")) if empty_string_as_null else F.when(there, F.coalesce(text, F.lit("")))
        else:
            text = F.nullif(text, F.lit(""))
            value = F.from_json(text, f.dataType) if isinstance(f.dataType, (ArrayType, MapType, StructType)) else text.try_cast(f.dataType)
            bad = F.coalesce(bad, F.when(text.isNotNull() & value.isNull(), text))
        columns.append(value.alias(f.name))
    bad = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("broken line or value: "), bad)).cast("string")) if fail_fast else bad
    return rows.select(*columns, bad.alias(BROKEN), *[c for c in ("_file",) if c in rows.columns])


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def header_names(line: str, delimiter: str) -> list[str]:
    """The names in a header's line."""
    names = [n.strip() for n in next(csv.reader([line], delimiter=delimiter), [])]
    if not names or "" in names or len(set(names)) < len(names):
        raise ValueError(f"the header has no, empty or repeated names: {line}")
    return names


def _line(spark: SparkSession, paths: list[str], skip: int) -> str:
    """The line after so many at the start of one of the files, empty if there is none."""
    files = sorted(spark.read.text(paths).inputFiles())
    if not files:
        return ""
    first = [r[0] for r in spark.read.option("lineSep", "\n").text(files[0]).limit(skip + 1).collect()]  # skip + 1 lines
    return first[skip].rstrip("\r") if len(first) > skip else ""


def _after_first_lines(spark: SparkSession, paths: list[str], skip: int, header: str | None) -> DataFrame:
    """(_file, line) without the first skip lines of each file and its header, which has to be this one. Files are read in
    blocks as ever; lines are counted only in a file's first block, which has to hold all of these. Values with line
    breaks are not supported here."""
    rows = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line"))

    def run(batches):
        at, seen = None, 0
        for b in batches:
            keep = []
            for i, (file, start) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if (file, start) != at:
                    at, seen = (file, start), 0
                seen += 1
                named_here = header is not None and seen == skip + 1
                if start == 0 and named_here and (found := b.column(2)[i].as_py().rstrip("\r")) != header:
                    raise ValueError(f"{file} has another header: {found}")
                keep.append(start > 0 or seen > skip and not named_here)
            yield b.filter(pa.array(keep, pa.bool_())).select([0, 2])

    out = rows.mapInArrow(run, "_file string, line string")
    return out.select("_file", F.regexp_replace("line", "\r$", "").alias("line"))


def copy_summary(spark: SparkSession, paths: str | list[str], schema: StructType | str, format: str | None = None, *, header: bool = True, delimiter: str = ",") -> DataFrame:
    """RETURN SUMMARY: (uri, success_count, error_count) by file."""
    _, rows = _read(spark, paths, schema, format, header, delimiter, 0, False, False)
    first = next(c for c in rows.columns if c not in (BROKEN, "_file"))
    got = rows.groupBy(F.col("_file").alias("uri")).agg(F.count_if(F.col(BROKEN).isNull()).alias("good"), F.count_if(F.col(BROKEN).isNotNull()).alias("error_count"), F.count(first).alias("_seen"))
    return got.select("uri", F.least("good", F.col("good") + F.col("_seen")).alias("success_count"), "error_count")  # readers want one real column read


def copy_to(df: DataFrame, folder: str, format: str = "json_object", compression: str | None = None) -> int:
    """Exports df as JSON lines (json_object), or as arrays of its values (json_array); returns the number of rows,
    counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n"))
    if format == "json_array":
        # the JSON of a value, nulls and empty objects included, is that of {"v":value} without its frame
        framed = [F.to_json(F.struct(F.col(c).alias("v")), {"ignoreNullFields": "false"}) for c in df.columns]
        one = F.concat_ws(",", *[F.substr(x, F.lit(6), F.char_length(x) - 6) for x in framed])
        w = out.select(F.concat(F.lit("["), one, F.lit("]")).alias("value")).write
        w = w.option("compression", compression) if compression else w
        w.text(folder)
    else:
        w = out.write.option("ignoreNullFields", "false")
        w = w.option("compression", compression) if compression else w
        w.json(folder)
    return seen.get["n"]


def read_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Binary files by their SHA-1 digest."""
    return spark.read.format("binaryFile").load(folder).select(F.sha1("content").alias("digest"), "length", "content", "path")
