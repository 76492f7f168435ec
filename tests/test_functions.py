"""Semantic traps, one by one, on literals."""

import pytest
from pyspark.sql import functions as F

from strataflow.functions import arrays, geo, maths, objects, strings, times
from strataflow.operators import aggregates as A
from strataflow.operators import relational as R
from strataflow.operators import tablefuncs as TF


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


L = F.lit


def cases():
    return [
        (strings.substr(L("abc"), 0, 2), "ab"), (strings.left(L("abcd"), -1), "abc"), (strings.right(L("abcd"), -1), "bcd"), (strings.right(L("abcd"), 2), "cd"), (strings.lpad(L("abc"), 0), ""),
        (strings.concat(L("a"), L(None), L("b")), "ab"), (strings.concat_op(L("a"), L(None).cast("string")), None), (strings.chr_(L(300)), "Ĭ"), (strings.chr_(L(0x1F600)), "😀"),
        (strings.regexp_replace(L("aXbXc"), "X", "-"), "a-bXc"), (strings.regexp_replace(L("aXbXc"), "x", "-", "gi"), "a-b-c"), (strings.regexp_replace(L("ab"), "(a)(b)", "$2$1"), "ba"),
        (strings.regexp_instr(L("abcabc"), "c", 1, 2), 6), (strings.regexp_instr(L("abcabc"), "b", 1, 1, True), 3), (strings.regexp_count(L("aaa"), "a", 2), 2), (strings.substr_pattern(L("foobar"), "o(.)b"), "o"),
        (strings.substr_pattern(L("x"), "y"), None), (strings.string_to_array(L("abc"), None), ["a", "b", "c"]), (strings.string_to_array(L(""), ","), []), (strings.string_to_array(L("a.b"), "."), ["a", "b"]),
        (strings.array_to_string(F.array(L("a"), L(None), L("b")), ",", "?"), "a,?,b"), (strings.quote_ident(L('a"b')), '"a""b"'), (strings.full_match(L("abc"), "b"), False), (strings.split_part(L("a,b"), ",", 3), ""),
        (maths.divide(L(7), L(2)), 3), (maths.divide(L(-7), L(2)), -3), (maths.modulus(L(-7), L(2)), -1), (maths.round_(L(-2.5)), -2), (maths.round_(L(2.5)), 3), (maths.trunc(L(-2.7)), -2), (maths.trunc(L(2.789), 2), 2.78),
        (maths.log(L(8.0), 2.0), 3.0), (maths.log(L(100.0)), 2.0), (maths.bit_strings("or", L("01"), L("10")), "11"),
        (arrays.position(F.array(L(1), L(None), L(2)), L(None)), 2), (arrays.position(F.array(L(1)), 9), None), (arrays.difference(F.array(L(1), L(1), L(2)), F.array(L(2))), [1, 1]), (arrays.overlap(F.array(L(1), L(None)), F.array(L(None).cast("int"))), True),
        (arrays.slice_(F.array(L(1), L(2), L(3)), 2), [2, 3]), (arrays.set_(F.array(L(1)), 3, 9), [1, None, 9]), (arrays.length(F.array().cast("array<int>")), None), (arrays.sum_(F.array(L(None).cast("int"))), None), (arrays.get(F.array(L(1)), 5), None),
        (geo.geohash(geo.point(L(10.40744), L(57.64911)), 11), "u4pruydqqvj"), (objects.json_subscript(L('{"a": {"b": 3}}'), "a", "b"), "3"),
    ]


def test_scalars(spark):
    wrong = [(i, got, want) for i, (c, want) in enumerate(cases()) if (got := one(spark, c)) != want]
    assert not wrong


@pytest.mark.parametrize("f", [lambda: maths.sqrt(L(-1.0)), lambda: maths.ln(L(0.0)), lambda: maths.divide(L(1), L(0)), lambda: strings.chr_(L(0)), lambda: maths.asin(L(2.0)), lambda: maths.bit_strings("and", L("0"), L("00"))])
def test_errors(spark, f):
    with pytest.raises(Exception):  # noqa: B017
        one(spark, f())


def test_bad_arguments(spark):
    for f in (lambda: times.date_trunc("era", L(1)), lambda: times.date_bin("0 days", L(1)), lambda: strings.split_part(L("a"), ",", 0), lambda: arrays.slice_(L(1), 0, 1)):
        with pytest.raises(ValueError):
            f()


def test_null_order(spark):
    df = spark.sql("select * from values (1), (null), (2) as v(x)")
    assert [r.x for r in R.order(df, "x").collect()] == [1, 2, None]
    assert [r.x for r in R.order(df, "-x").collect()] == [None, 2, 1]


def test_project_set_is_lock_step(spark):
    df = spark.range(2).withColumn("a", F.array(L(1), L(2), L(3)))
    rows = TF.unnest(df, ["id"], a=F.col("a"), b=F.array(L("x"))).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(i, a, b) for i in range(2) for a, b in ((1, "x"), (2, None), (3, None))], key=str)


def test_array_agg_keeps_nulls(spark):
    df = spark.sql("select * from values (1), (null), (2) as v(x)")
    assert sorted(df.agg(A.array_agg(F.col("x")).alias("x")).first().x, key=str) == [1, 2, None]


def test_geometric_mean_and_variance(spark):
    df = spark.sql("select * from values (1.0D), (4.0D) as v(x)")
    r = df.agg(A.geometric_mean(F.col("x")).alias("g"), A.variance(F.col("x")).alias("v")).first()
    assert round(r.g, 9) == 2.0 and r.v == 2.25


def test_quantified_comparisons(spark):
    df = spark.sql("select * from values (1), (5), (null) as v(x)")
    some, empty, unknown = (spark.sql(f"select * from values {v} as v(y)") for v in ("(1), (3)", "(1)", "(1), (null)"))
    empty = empty.where("false")
    assert [r.x for r in R.compare_all(df, F.col("x"), ">", some).collect()] == [5]
    assert len(R.compare_all(df, F.col("x"), ">", empty).collect()) == 3
    assert R.compare_all(df, F.col("x"), ">", unknown).collect() == []
    assert [r.x for r in R.compare_any(df, F.col("x"), ">", unknown).collect()] == [5]
    assert R.not_in(df, "x", unknown).collect() == []


def test_lttb_keeps_ends():
    import numpy as np

    x = np.arange(100.0)
    kept = A.keep_largest_triangles(x, np.sin(x), 10)
    assert len(kept) == 10 and kept[0] == 0 and kept[-1] == 99 and (np.diff(kept) > 0).all()
    assert len(A.keep_largest_triangles(x, x, 0)) == 100
