"""Network functions, hashes, the SQL names, table definitions and session statements."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions import network, sql, system
from strataflow.operators import schema, statements
from strataflow.operators.schema import Column, Table


def test_blake3():
    assert network.blake3_hex(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert network.blake3_hex(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    assert len({network.blake3_hex(bytes(n)) for n in (1023, 1024, 1025, 2048, 3073, 5000)}) == 6


def test_network(spark):
    df = spark.createDataFrame([("10.1.2.3", "10.0.0.0/8"), ("11.0.0.1", "10.0.0.0/8"), ("::1", "::/64"), (None, "::/64")], "ip string, net string")
    assert [r.x for r in df.select(network.in_network(F.col("ip"), F.col("net")).alias("x")).collect()] == [True, False, True, None]
    assert [r.x for r in df.limit(2).select(network.in_network4(F.col("ip"), "10.0.0.0/8").alias("x")).collect()] == [True, False]
    ids = spark.createDataFrame([('Doc."Tab""le".x',)], "s string")
    assert ids.select(network.parse_ident(F.col("s")).alias("x")).first().x == ["doc", 'Tab"le', "x"]
    assert ids.select(network.blake3(F.lit("abc")).alias("x")).first().x.startswith("6437b3ac")


def test_sql_names(spark):
    sql.register(spark)
    r = spark.sql("select int_divide(-7, 2) as q, math_round(-2.5D) as r, regexp_matches_whole('abc', 'b') as m, array_difference(array('a', 'a', 'b'), array('b')) as d, date_bin(3600000000, timestamp_ntz'2024-01-01 10:59:00', timestamp_ntz'2024-01-01') as b").first()
    assert (r.q, r.r, r.m, r.d, str(r.b)) == (-3, -2, False, ["a", "a"], "2024-01-01 10:00:00")
    sql.create_function(spark, "twice", "x * 2", "int", "x int")
    assert spark.sql("select twice(4) as x").first().x == 8
    sql.drop_function(spark, "twice")


def test_system(spark):
    df = spark.range(1)
    r = df.select(system.pg_typeof(F.lit(1)).alias("t"), system.format_type(F.lit(23)).alias("f"), system.current_schemas().alias("s"), system.has_privilege().alias("p"), system.description().alias("d")).first()
    assert (r.t, r.f, r.s, r.p, r.d) == ("int", "integer", ["default"], True, None)
    with pytest.raises(ValueError):
        system.current_setting(spark, "no.such.setting")


def test_table_definition(spark):
    t = Table([Column("id", "int"), Column("price", "double", not_null=True, default="1.5"), Column("twice", "double", generated="price * 2")], key=["id"], checks={"positive": "price > 0"})
    rows = spark.createDataFrame([(1, 2.0, "x"), (2, 3.0, "y")], "id int, price double, more string")
    assert [tuple(r) for r in t.conform(rows).collect()] == [(1, 2.0, 4.0, "x"), (2, 3.0, 6.0, "y")]
    assert t.conform(rows.select("id")).first().price == 1.5
    t.policy = schema.IGNORED
    assert t.conform(rows).columns == ["id", "price", "twice"]
    t.policy = schema.STRICT
    with pytest.raises(ValueError):
        t.conform(rows)
    for bad in ("select 1 as id, -1.0D as price", "select cast(null as int) as id, 1.0D as price"):
        with pytest.raises(Exception):  # noqa: B017
            t.conform(spark.sql(bad)).collect()
    assert "primary key (id)" in t.show_create("t")


def test_statements(spark):
    spark.sql("drop table if exists seen")
    spark.range(10).write.saveAsTable("seen")
    statements.analyze(spark, "seen")
    assert "Aggregate" in statements.explain(spark.table("seen").groupBy("id").count())
    assert statements.information_schema_columns(spark, "seen").first().column_name == "id"
    assert statements.show_create(spark, "seen").upper().startswith("CREATE TABLE")
    assert statements.information_schema_tables(spark).where("table_name = 'seen'").count() == 1


@pytest.mark.parametrize("settings", [{"spark.sql.adaptive.enabled": "false"}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushPredicateThroughJoin,org.apache.spark.sql.catalyst.optimizer.ColumnPruning"}])
@pytest.mark.parametrize("name", ["shipping_priority", "join_full", "subquery_not_in_null", "agg_distinct_group"])
def test_same_rows_whatever_the_plan(spark, folder, settings, name):
    from strataflow.plans import analytics, registry, relational  # noqa: F401

    want = sorted(map(str, registry.QUERIES[name](spark, folder).collect()))
    old = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert sorted(map(str, registry.QUERIES[name](spark, folder).collect())) == want
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_blake3_of_many(spark):
    """Messages together as alone, over the sizes at which chunks and trees change."""
    messages = [bytes(i % 251 for i in range(n)) for n in (0, 1, 64, 65, 1024, 1025, 2048, 2049, 3072, 3073, 5000, 9000)]
    assert network.blake3_many(messages) == [network.blake3_hex(m) for m in messages] and network.blake3_many([]) == []
    #: From the published test vectors, input bytes counting up to 250 over and over.
    known = {1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"}
    for n, want in known.items():
        assert network.blake3_hex(bytes(i % 251 for i in range(n))) == want
    df = spark.createDataFrame([("abc",), (None,), ("",)], "s string")
    assert [r.x and r.x[:8] for r in df.select(network.blake3(F.col("s")).alias("x")).collect()] == ["6437b3ac", None, "af1349b9"]


def test_percentiles(spark):
    """Against numpy, with repeats, nulls and single values."""
    import numpy as np

    from strataflow.operators import aggregates as A

    rows = [("a", float(v)) for v in (3, 1, 1, 1, 7, 2)] + [("b", 5.0), ("c", None), ("a", None), ("d", 1.0), ("d", 2.0)]
    got = {r.k: (r.lo, r.mid, r.hi) for r in A.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": 0.0, "mid": 0.3, "hi": 1.0}).collect()}
    values = {k: [v for j, v in rows if j == k and v is not None] for k in "abd"}
    assert got.keys() == values.keys() and all(np.allclose(got[k], np.quantile(v, [0, 0.3, 1])) for k, v in values.items())
