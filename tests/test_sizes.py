"""Registered queries on inputs that only larger tables have: sums beyond a type's range, ties, many values, several processes."""

import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from strataflow.operators import aggregates as A
from strataflow.plans import registry, relational, statements  # noqa: F401
from strataflow.sources.jdbc import Foreign, shared_database


def test_interval_sums_beyond_292_thousand_years(spark):
    one = spark.sql("select timestamp_ntz'9995-01-01' - timestamp_ntz'1995-01-01' as x, 0L as months, 9000000000000000000L as micros")
    rows = one.crossJoin(spark.range(50)).select("x", F.struct("months", "micros").alias("m"), "id")
    year = 8000 * 146097 // 400 * 86400
    assert rows.agg(A.sum_seconds(F.col("x")).alias("s")).first().s == 50 * year
    part = spark.sql("select timestamp_ntz'1994-12-31 23:59:58.5' - timestamp_ntz'1995-01-01' as x union all select null")
    assert part.agg(A.sum_seconds(F.col("x")).alias("s")).first().s == -1
    assert rows.agg(A.avg_intervals(F.col("m")).alias("s")).first().s.micros == 9000000000000000000
    there_and_back = rows.where("id < 3").withColumn("m", F.struct(F.lit(0).cast("long").alias("months"), F.when(F.col("id") == 2, -9 * 10**18).otherwise(9 * 10**18).alias("micros")))
    assert there_and_back.agg(A.sum_intervals(F.col("m")).alias("s")).first().s.micros == 9 * 10**18
    none = spark.sql("select cast(null as struct<months: bigint, micros: bigint>) as m")
    assert none.agg(A.sum_intervals(F.col("m")).alias("s")).first().s.micros is None


@pytest.mark.parametrize("name", ["agg_intervals"])
def test_interval_query_over_many_orders(spark, tmp_path, name):
    day = F.expr("timestamp_ntz'1998-01-01 00:00:00.25' - make_dt_interval(cast(id % 7 * 300 as int))")
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, F.lit("O")).alias("o_orderstatus"), F.when(F.col("id") % 5 > 0, day + F.expr("make_dt_interval(365 * 20)")).otherwise(day).alias("o_orderdate"))
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
        want = c.execute(registry.SQL[name]).fetchall()
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).select("o_orderstatus", "seconds", "least").collect()), key=str) == sorted(want, key=str)


def test_foreign_table_is_read_by_other_processes(folder, tmp_path):
    """A cluster of two executors, each a process of its own."""
    code = """
import json, sys
from strataflow.plans import registry, statements
from strataflow.session import build

folder, shared = sys.argv[1:]
spark = build("local-cluster[2,1,1024]", "foreign", spark__ui__enabled="false", spark__checkpoint__dir="file://" + shared, spark__driver__host="127.0.0.1", spark__executor__memory="800m")
print(json.dumps([list(r) for r in registry.QUERIES["foreign_jdbc"](spark, folder).collect()]))
spark.stop()
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_", "SPARK_"))} | {"PYTHONPATH": repo}
    got = subprocess.run([sys.executable, "-c", code, folder, str(tmp_path)], capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path)
    assert got.returncode == 0, got.stderr[-2000:]
    with duckdb.connect() as c:
        c.execute(f"create view nation as select * from '{folder}/nation.parquet'")
        assert sorted(map(tuple, json.loads(got.stdout.splitlines()[-1]))) == sorted(c.execute(registry.SQL["foreign_jdbc"]).fetchall())


def test_shared_database_keeps_values(spark):
    rows = [(1, 1 << 40, 0.5, "x" * 40_000), (2, None, None, None), (None, -1, -2.0, "")]
    f = Foreign()
    f.create_server("s", shared_database(spark.createDataFrame(rows, "i int, b bigint, d double, s string"), "facts"))
    f.create_table("t", "s", "facts")
    got = f.read(spark, "t")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(rows, key=str)
    assert [r.b for r in got.where("i > 1").collect()] == [None] and got.columns == ["i", "b", "d", "s"]


def test_max_by_takes_the_least_key_of_ties(spark, tmp_path):
    """Like the other engine, which takes the first row where it runs in order; nulls of either column don't count."""
    rows = [(k, k % 7 + (k % 2) * 0.5 if k % 11 else None, "AB"[k % 2] if k % 13 else None) for k in range(-50, 400)] + [(None, 99.0, "A"), (None, -9.0, "A"), (-(2**63), 0.0, "C"), (2**63 - 1, 0.0, "C"), (1, float("nan"), "D"), (2, 5.0, "D"), (9, None, "E")]
    spark.createDataFrame(sorted(rows, key=lambda r: (r[0] is None, r[0])), "c_custkey bigint, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    with duckdb.connect(config={"threads": 1}) as c:
        c.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
        want = c.execute(registry.SQL["agg_max_by"]).fetchall()
    got = registry.QUERIES["agg_max_by"](spark, str(tmp_path)).select("c_mktsegment", "richest", "poorest").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("values", [30_000, 8193, 5, 0])
def test_first_of_more_values_than_a_sketch_takes(spark, tmp_path, values):
    """Counts that differ little, so that no value stands out; one of the values is null."""
    rows = spark.range(values).select(F.when(F.col("id") != 4, F.col("id")).alias("l_suppkey"), F.explode(F.sequence(F.lit(0), (F.col("id") % 7).cast("int"))))
    rows.repartition(5).write.parquet(f"{tmp_path}/lineitem.parquet")
    with duckdb.connect() as c:
        c.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        want = c.execute(registry.SQL["agg_topk_sketch_first"]).fetchall()
        five = c.execute("select l_suppkey, count(*) from lineitem group by 1 order by 2 desc, 1 nulls last limit 5").fetchall()
    assert list(map(tuple, registry.QUERIES["agg_topk_sketch_first"](spark, str(tmp_path)).collect())) == want
    assert list(map(tuple, registry.QUERIES["agg_topk_sketch"](spark, str(tmp_path)).select("item", "count").collect())) == five


def test_sketch_that_is_too_small_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(A, "hyperloglog_distinct", lambda x: F.lit(1))
    with pytest.raises(Exception, match="drop values"):
        A.top_sketched(spark.range(40_000), "id", 1, 1024).collect()


def test_one_sketch_a_group_beside_exact_counts(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 > 0, F.when(F.col("id") % 3 > 1, "R").otherwise("A")).alias("l_returnflag"), F.when(F.col("id") % 5 > 0, F.col("id") % 7001).alias("l_partkey"))
    rows.union(spark.sql("select 'N', cast(null as bigint)")).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.QUERIES["agg_hyperloglog_error"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("A", True), ("N", True), ("R", True), (None, True)], key=str)
    plan = df._jdf.queryExecution().sparkPlan().toString().splitlines()
    sketches = [x for x in plan if "approx_count_distinct" in x and "Aggregate" in x]
    assert sketches and not any("l_partkey" in x[x.index("keys=[") : x.index("], functions")] for x in sketches)
