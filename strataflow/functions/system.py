"""Session and catalogue functions that PostgreSQL clients ask for; privileges are always granted, there being no roles."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Type numbers that PostgreSQL clients know.
TYPES = {16: "boolean", 17: "bytea", 18: '"char"', 20: "bigint", 21: "smallint", 23: "integer", 25: "text", 114: "json", 700: "real", 701: "double precision", 1043: "character varying", 1082: "date", 1114: "timestamp without time zone", 1184: "timestamp with time zone", 1186: "interval", 1700: "numeric", 2950: "uuid"}


def current_user() -> Column:
    return F.current_user()


def current_schema() -> Column:
    return F.current_schema()


def current_schemas(implicit: bool = False) -> Column:
    return F.array(F.lit("pg_catalog"), F.current_schema()) if implicit else F.array(F.current_schema())


def current_database() -> Column:
    return F.current_catalog()


def current_setting(spark: SparkSession, name: str, missing_ok: bool = False) -> Column:
    value = spark.conf.get(name, None)
    if value is None and not missing_ok:
        raise ValueError(f"unknown setting {name}")
    return F.lit(value)


def version() -> Column:
    return F.version()


def pg_typeof(x: Column) -> Column:
    return F.typeof(x)


def format_type(oid: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), oid), F.lit("???"))


def pg_encoding_to_char(code: Column) -> Column:
    return F.when(code == 6, "UTF8")


def description() -> Column:
    """obj_description, col_description: nothing is known."""
    return F.lit(None).cast("string")


pg_get_expr = pg_get_partkeydef = pg_get_serial_sequence = description  # there are no such catalogue entries either


def constraint_definition(key: list[str], check: str | None = None) -> Column:
    """pg_get_constraintdef: of a primary key, or of a CHECK."""
    return F.lit(f"CHECK ({check})" if check else f"PRIMARY KEY ({', '.join(key)})")


def table_is_visible(spark: SparkSession, name: str) -> Column:
    """pg_table_is_visible: whether the name alone finds a table or view."""
    return F.lit(spark.catalog.tableExists(name))


def function_is_visible(spark: SparkSession, name: str) -> Column:
    return F.lit(spark.catalog.functionExists(name))


#: Privileges by what they are granted on.
PRIVILEGES = {"table": ("select", "insert", "update", "delete"), "schema": ("create", "usage"), "database": ("create", "connect", "temporary", "temp"), "function": ("execute",)}


def has_privilege(kind: str = "table", names: str = "select") -> Column:
    """has_table_privilege, has_schema_privilege, has_database_privilege, has_function_privilege: granted to the one user
    there is; names of privileges (by commas) that the kind does not have raise."""
    for name in names.lower().split(","):
        if name.strip() not in PRIVILEGES[kind]:
            raise ValueError(f"unrecognized privilege {name.strip()}")
    return F.lit(True)


def random_uuid() -> Column:
    return F.expr("uuid()")


def backend_pid(spark: SparkSession) -> Column:
    """The process of the driver, as the one that serves the session."""
    return F.lit(int(spark.sparkContext._jvm.java.lang.ProcessHandle.current().pid()))


def postmaster_start_time(spark: SparkSession) -> Column:
    return F.timestamp_millis(F.lit(spark.sparkContext.startTime))


def user_by_id(oid: Column) -> Column:
    """There is one user; any id names it."""
    return F.when(oid.isNotNull(), F.current_user())


def function_result(spark: SparkSession, name: str) -> Column:
    """The usage line of a function, null if there is none of that name."""
    return F.lit(next((r[0].removeprefix("Usage: ") for r in spark.sql(f"describe function {name}").collect() if r[0].startswith("Usage: ")), None)).cast("string")
