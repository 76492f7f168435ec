"""Session statements: EXPLAIN, ANALYZE, SHOW, SET, KILL and the information schema, over Spark's own catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def explain(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text; mode: simple, extended, codegen, cost or formatted."""
    jvm = df.sparkSession.sparkContext._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def explain_analyze(df: DataFrame) -> str:
    """The plan that ran, with what adaptive execution made of it."""
    df.write.format("noop").mode("overwrite").save()
    return explain(df)


def analyze(spark: SparkSession, table: str, columns: list[str] | None = None) -> None:
    """Statistics of a table, for the cost-based rules."""
    spark.sql(f"analyze table {table} compute statistics" + (f" for columns {', '.join(columns)}" if columns else " for all columns"))


def show_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("show tables")


def show_schemas(spark: SparkSession) -> DataFrame:
    return spark.sql("show schemas")


def show_columns(spark: SparkSession, table: str) -> DataFrame:
    return spark.sql(f"show columns in {table}")


def show_create(spark: SparkSession, table: str) -> str:
    return spark.sql(f"show create table {table}").first()[0]


def create_schema(spark: SparkSession, name: str, folder: str | None = None) -> None:
    spark.sql(f"create schema if not exists {name}" + (f" location '{folder}'" if folder else ""))


def drop_schema(spark: SparkSession, name: str, cascade: bool = False) -> None:
    spark.sql(f"drop schema {name} {'cascade' if cascade else 'restrict'}")


def drop_table(spark: SparkSession, name: str, if_exists: bool = False) -> None:
    spark.sql(f"drop table {'if exists ' if if_exists else ''}{name}")


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"alter table {old} rename to {new}")


def refresh(spark: SparkSession, table: str) -> None:
    """REFRESH TABLE: files that were written past the catalogue are seen."""
    spark.catalog.refreshTable(table)


def transaction(statement: str) -> None:
    """BEGIN, COMMIT, END, SET TRANSACTION: accepted and without effect, as there are no transactions; others raise."""
    if statement.lower().split()[0] not in ("begin", "start", "commit", "end") and not statement.lower().startswith(("set transaction", "set session characteristics")):
        raise ValueError(f"not supported: {statement}")


def set_(spark: SparkSession, name: str, value: str | None) -> None:
    """SET, or RESET if value is None."""
    spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def disable_rule(spark: SparkSession, *rules: str) -> None:
    """Switch optimizer rules off for this session, by class name."""
    spark.conf.set("spark.sql.optimizer.excludedRules", ",".join(f"org.apache.spark.sql.catalyst.optimizer.{r}" for r in rules))


def run_as(spark: SparkSession, job: str) -> None:
    spark.sparkContext.setJobGroup(job, job, interruptOnCancel=True)


def kill(spark: SparkSession, job: str) -> None:
    spark.sparkContext.cancelJobGroup(job)


def discard(spark: SparkSession) -> None:
    """DISCARD ALL: caches and temporary views go."""
    spark.catalog.clearCache()
    for t in spark.catalog.listTables():
        if t.isTemporary:
            spark.catalog.dropTempView(t.name)


def information_schema_tables(spark: SparkSession) -> DataFrame:
    rows = [(t.namespace[0] if t.namespace else None, t.name, "VIEW" if t.isTemporary or t.tableType == "VIEW" else "BASE TABLE") for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string")


def information_schema_columns(spark: SparkSession, table: str) -> DataFrame:
    rows = [(table, f.name, i + 1, f.dataType.simpleString(), f.nullable) for i, f in enumerate(spark.table(table).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position int, data_type string, is_nullable boolean")
