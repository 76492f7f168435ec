"""Files in and out, changes to tables, foreign tables, streams."""

import gzip
import os

import pytest
from pyspark.sql import functions as F

from strataflow.operators import dml
from strataflow.operators import relational as R
from strataflow.operators import textsearch as T
from strataflow.operators import timeseries as TS
from strataflow.sources import files
from strataflow.sources.jdbc import Foreign
from strataflow.streaming import windows as SW

CSV = 'id,quote\n1,"Don\'t panic, ""friend"""\n2,Zürich\n'


def test_copy_from_csv(spark, tmp_path):
    (tmp_path / "q.csv").write_text(CSV)
    rows = files.copy_from(spark, str(tmp_path / "q.csv"), "id int, quote string").collect()
    assert [tuple(r) for r in rows] == [(1, 'Don\'t panic, "friend"'), (2, "Zürich")]
    (tmp_path / "n.csv").write_text("comment\n" + CSV)
    assert files.copy_from(spark, str(tmp_path / "n.csv"), "id int, quote string", skip=1).count() == 2


def test_copy_from_json_gzip_and_summary(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write('{"id": 1, "quote": "x"}\n{"id": 2, broken\n{"id": 3}\n')
    rows = files.copy_from(spark, str(tmp_path / "*.json.gz"), "id int, quote string").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (3, None)] or sorted(r.id for r in rows) == [1, 3]
    s = files.copy_summary(spark, str(tmp_path / "*.json.gz"), "id int, quote string").first()
    assert (s.success_count, s.error_count) == (2, 1)
    with pytest.raises(Exception):  # noqa: B017
        files.copy_from(spark, str(tmp_path / "*.json.gz"), "id int, quote string", fail_fast=True).collect()


def test_copy_to(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    assert files.copy_to(df, str(tmp_path / "o")) == 2
    assert spark.read.json(str(tmp_path / "o")).count() == 2
    assert files.copy_to(df.coalesce(1), str(tmp_path / "r"), "json_array") == 2
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ['[1,"a"]', "[2,null]"]


def test_upsert_update_delete(spark):
    t = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    new = spark.createDataFrame([(2, 5), (3, 7), (3, 7)], "k int, v int")
    assert sorted(map(tuple, dml.insert_on_conflict(t, new, ["k"]).collect())) == [(1, 10), (2, 20), (3, 7)]
    got = dml.insert_on_conflict(t, new, ["k"], {"v": F.col("v") + F.col("excluded.v")})
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 25), (3, 7)]
    assert sorted(map(tuple, dml.update(t, F.col("k") == 1, {"v": F.lit(0)}).collect())) == [(1, 0), (2, 20)]
    assert dml.delete(t, F.lit(None).cast("boolean")).count() == 2


def test_replace_optimize_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(path)
    dml.delete_partitions(spark, path, "p", [1])
    assert spark.read.parquet(path).count() == 5
    dml.replace_table(spark.read.parquet(path).where("id > 2"), path)
    dml.optimize(spark, path, 1)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [4, 6, 8]
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 1


def test_bucketed_join_needs_no_shuffle(spark):
    for n in ("b1", "b2"):
        spark.sql(f"drop table if exists {n}")
        dml.create_table_as(spark.range(100).withColumn("v", F.col("id") * 2), n, bucket_by=["id"], buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("b1").join(spark.table("b2"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    dml.swap_tables(spark, "b1", "b2")


def test_cursor(spark):
    c = dml.Cursor(spark.range(5), scroll=True)
    assert [r.id for r in c.fetch(3)] == [0, 1, 2]
    assert [r.id for r in c.fetch(-2)] == [2, 1]
    assert [r.id for r in c.fetch(10)] == [1, 2, 3, 4]


def test_filters_reach_the_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "l_comment" not in plan


def test_top_k_does_not_sort_everything(spark, folder):
    df = R.top(spark.read.parquet(f"{folder}/orders.parquet"), ["-o_totalprice", "o_orderkey"], 5)
    assert "TakeOrderedAndProject" in df._jdf.queryExecution().executedPlan().toString()


def test_foreign_registry():
    f = Foreign()
    f.create_server("s", "jdbc:postgresql://host/db")
    f.create_user_mapping("s", "u", "p")
    f.create_table("t", "s", "facts", "public")
    assert f.options("t") == {"url": "jdbc:postgresql://host/db", "dbtable": "public.facts", "user": "u", "password": "p"}
    f.drop_server("s")
    assert not f.tables


def test_foreign_table_over_jdbc(spark):
    jvm = spark.sparkContext._jvm
    url = "jdbc:derby:memory:foreign;create=true"
    con = jvm.java.sql.DriverManager.getConnection(url)
    st = con.createStatement()
    st.execute("create table facts (id int, v double)")
    st.execute("insert into facts values (1, 1.5), (2, 2.5), (3, 3.5)")
    f = Foreign()
    f.create_server("s", url)
    f.create_table("t", "s", "FACTS")
    df = f.read(spark, "t", column="ID", low=1, high=3, parts=2).where("ID > 1").select("V")
    assert sorted(r.V for r in df.collect()) == [2.5, 3.5]
    assert "PushedFilters" in df._jdf.queryExecution().executedPlan().toString()


def test_gap_fill(spark):
    df = spark.sql("select 'a' as k, timestamp_ntz'2024-01-01 00:10:00' as ts union all select 'a', timestamp_ntz'2024-01-01 03:00:00'")
    out = TS.fill_gaps(TS.binned(df, "ts", "1 hour", ["k"], F.count("*").alias("n")), ["k"], "1 hours", {"n": 0})
    assert [r.n for r in out.orderBy("bucket").collect()] == [1, 0, 0, 1]


def test_analyzers(spark):
    df = spark.createDataFrame([("<b>The quick</b> /a/b",)], "t string")
    tok = lambda a: df.select(a.tokens(F.col("t")).alias("x")).first().x
    assert tok(T.ANALYZERS["html"]) == ["the", "quick", "a", "b"]
    assert tok(T.Analyzer("edge_ngram", least=1, most=2))[:2] == ["b", "b"]
    assert df.select(T.match(F.col("t"), "quick b a", kind="phrase").alias("x")).first().x is True
    assert df.select(T.match(F.col("t"), "quick a", kind="phrase").alias("x")).first().x is False


def test_stream_upsert(spark, tmp_path):
    schema = "k int, v int, at int"
    spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 5, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = SW.ingest(spark, str(tmp_path / "in"), schema)
    for _ in range(2):
        SW.upsert(stream, str(tmp_path / "out"), ["k"], "at", str(tmp_path / "ck")).awaitTermination()
        spark.createDataFrame([(2, 9, 9)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [(1, 2, 2), (2, 9, 9)]


def test_null_sets_are_empty(spark):
    """A row goes only if none of its sets has a value."""
    df = spark.sql("select * from values (1, array(1, 2), array('a')), (2, null, array('x', 'y')), (3, array(5), null), (4, null, null), (5, array(), array('q')), (6, array(), null) as t(i, a, b)")
    rows = R.project_set(df, ["i"], a=F.col("a"), b=F.col("b")).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, 1, "a"), (1, 2, None), (2, None, "x"), (2, None, "y"), (3, 5, None), (5, None, "q")]


def test_not_in_broadcasts_counts_only(spark, folder):
    orders, customer = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("orders", "customer"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = R.not_in(orders, "o_custkey", customer.select("c_custkey"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_header_names_the_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('b, a,extra\n"x, y",1,q\n  z  ,2,r\n')
    (tmp_path / "b.csv").write_text("b, a,extra\nw,3,s\n")
    want = [(1, "x, y", None), (2, "z", None), (3, "w", None)]
    assert sorted(map(tuple, files.copy_from(spark, str(tmp_path / "?.csv"), "a int, b string, missing date").collect())) == want
    for n in "ab":
        (tmp_path / f"s{n}.csv").write_text("about\n\n" + (tmp_path / f"{n}.csv").read_text())
    assert sorted(map(tuple, files.copy_from(spark, str(tmp_path / "s?.csv"), "a int, b string, missing date", skip=2).collect())) == want
    assert sorted(map(tuple, files.copy_summary(spark, str(tmp_path / "?.csv"), "a int, b string").select("success_count", "error_count").collect())) == [(1, 0), (2, 0)]
    (tmp_path / "b.csv").write_text("a,b,extra\n3,w,s\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.copy_from(spark, str(tmp_path / "?.csv"), "a int, b string").collect()
    (tmp_path / "sb.csv").write_text("about\n\na,b,extra\n3,w,s\n")
    with pytest.raises(Exception, match="another header"):
        files.copy_from(spark, str(tmp_path / "s?.csv"), "a int, b string", skip=2).collect()
    (tmp_path / "d.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError, match="repeated"):
        files.copy_from(spark, str(tmp_path / "d.csv"), "a int")
    (tmp_path / "n.csv").write_text("1,x\n2,y\n")
    assert sorted(map(tuple, files.copy_from(spark, str(tmp_path / "n.csv"), "a int, b string", header=False).collect())) == [(1, "x"), (2, "y")]


def test_gaps_keep_null_groups_and_values(spark):
    rows = spark.sql("select * from values (null, timestamp_ntz'2024-01-01 00:00:00', 1, null), (null, timestamp_ntz'2024-01-01 02:00:00', 2, 5), ('a', timestamp_ntz'2024-01-01 00:00:00', null, 6), ('b', null, 7, 8) as t(k, bucket, n, v)")
    got = sorted([(r.k, r.bucket and r.bucket.hour, r.n, r.v) for r in TS.fill_gaps(rows, ["k"], "1 hour", {"n": 0}).collect()], key=str)
    assert got == sorted([(None, 0, 1, None), (None, 1, 0, None), (None, 2, 2, 5), ("a", 0, None, 6), ("b", None, 7, 8)], key=str)


def test_csv_lines_are_judged_alike_for_all_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b,c,d\n1,x,p,"[1, 2]"\n2,y\n3,z,q,[],LONG\n3,z,q,[],\n4,z,q,,,,\nbad,w,r,[3]\n5,,"",\n,v,s,[4]\n')
    path, schema = str(tmp_path / "t.csv"), "a int, b string, c string, d array<int>"
    want = [(1, "x", "p", [1, 2]), (2, "y", None, None), (5, "", "", None), (None, "v", "s", [4])]
    key = lambda r: str(r[0])
    assert sorted(map(tuple, files.copy_from(spark, path, schema).collect()), key=key) == want
    assert sorted([r.a for r in files.copy_from(spark, path, schema).select("a").collect()], key=str) == [1, 2, 5, None]
    assert sorted([r.b or "-" for r in files.copy_from(spark, path, "b string", empty_string_as_null=True).collect()]) == ["-", "v", "w", "x", "y"]
    assert [tuple(r)[1:] for r in files.copy_summary(spark, path, schema).collect()] == [(4, 4)]
    (tmp_path / "s.csv").write_text("note\n" + (tmp_path / "t.csv").read_text())
    assert sorted(map(tuple, files.copy_from(spark, str(tmp_path / "s.csv"), schema, skip=1).collect()), key=key) == want
    with pytest.raises(Exception, match="broken line or value"):
        files.copy_from(spark, path, schema, fail_fast=True).select("b").collect()
    (tmp_path / "n.csv").write_text("1,x\n2\n3,y,more\n")
    assert sorted(map(tuple, files.copy_from(spark, str(tmp_path / "n.csv"), "a int, b string", header=False).collect())) == [(1, "x"), (3, "y")]


@pytest.mark.parametrize("schema", ["b string", "a int, b string"])
def test_copied_rows_can_be_counted(spark, tmp_path, schema):
    (tmp_path / "t.json").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n\n{broken\n{"b": "z"}\n')
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n3,z,more\n4\n")
    for name in ("t.json", "t.csv"):
        got = files.copy_from(spark, str(tmp_path / name), schema)
        assert got.count() == len(got.collect()) == got.select("b").count() == 3
    (tmp_path / "u.json").write_text('{"a": "bad", "b": "x"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.copy_from(spark, str(tmp_path / "u.json"), "a int, b string", fail_fast=True).select("b").collect()
