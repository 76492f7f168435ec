"""The engine's function names for SQL text: temporary SQL functions, which Catalyst inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "int_divide(a bigint, b bigint) returns bigint": "a div b",
    "math_round(x double) returns bigint": "cast(floor(x + 0.5D) as bigint)",
    "math_trunc(x double, n int) returns double": "signum(x) * floor(abs(x) * power(10, n)) / power(10, n)",
    "log_of(x double, base double) returns double": "ln(x) / ln(base)",
    "variance_guard(x double) returns double": "if(x > 0, x, null)",
    "regexp_matches_whole(s string, p string) returns boolean": "s rlike concat('^(?:', p, ')$')",
    "date_bin(width bigint, ts timestamp_ntz, origin timestamp_ntz) returns timestamp_ntz": "cast(timestamp_micros(unix_micros(cast(ts as timestamp)) - pmod(unix_micros(cast(ts as timestamp)) - unix_micros(cast(origin as timestamp)), width)) as timestamp_ntz)",
    "array_difference(a array<string>, b array<string>) returns array<string>": "filter(a, x -> not exists(coalesce(b, array()), y -> x <=> y))",
    "array_place(a array<string>, v string) returns int": "nullif(cast(array_position(a, v) as int), 0)",
    "day_of_week(ts timestamp_ntz) returns int": "weekday(ts) + 1",
    "euclidean_similarity(a array<double>, b array<double>) returns double": "1 / (1 + aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
    "concat_all(a string, b string) returns string": "concat(coalesce(a, ''), coalesce(b, ''))",
    "ignore3vl(p boolean) returns boolean": "coalesce(p, false)",
}


def register(spark: SparkSession) -> None:
    for head, body in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")


def create_function(spark: SparkSession, name: str, body: object, returns: str, args: str | None = None) -> None:
    """CREATE FUNCTION: a SQL expression over args ('a int, b text'), or a Python function on pandas Series."""
    if isinstance(body, str):
        spark.sql(f"create or replace temporary function {name}({args or ''}) returns {returns} return {body}")
    else:
        from pyspark.sql import functions as F

        spark.udf.register(name, F.pandas_udf(body, returns))


def create_aggregate(spark: SparkSession, name: str, body: object, returns: str) -> None:
    """CREATE AGGREGATE: a Python function from pandas Series (one for each argument) to a value. A group of such an
    aggregate is held whole by one task; where built-in aggregates can be composed, compose them."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.functions import PandasUDFType

    spark.udf.register(name, F.pandas_udf(body, returns, PandasUDFType.GROUPED_AGG))


def create_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """CREATE FUNCTION .. RETURNS TABLE: a class whose eval yields rows for its arguments."""
    from pyspark.sql import functions as F

    spark.udtf.register(name, F.udtf(handler, returnType=returns))


def drop_function(spark: SparkSession, name: str) -> None:
    spark.sql(f"drop temporary function if exists {name}")
