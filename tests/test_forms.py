"""Phonetic and further token filters, HTTP sources, RETURNING, session functions."""

import gzip
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from strataflow.functions import system
from strataflow.operators import analysis as An
from strataflow.operators import dml
from strataflow.operators import phonetics as P
from strataflow.sources import web


@pytest.mark.parametrize(
    ("step", "tokens", "want"),
    [
        (P.soundex(), ["Robert", "Tymczak"], ["R163", "T522"]), (P.refined_soundex(), ["testing"], ["T6036084"]), (P.cologne(), ["Breschnew", "Müller-Lüdenscheidt"], ["17863", "65752682"]),
        (P.keyword_marker(["cats"], An.light_stem("english")), ["cats", "dogs"], ["cats", "dog"]), (P.stemmer_override({"mice": "mouse"}, An.light_stem("english")), ["mice", "dogs"], ["mouse", "dog"]),
        (P.pattern_capture([r"(\d+)", r"([a-z]+)"]), ["ab12"], ["ab12", "12", "ab"]), (P.word_delimiter(), ["PowerShot500-42's"], ["Power", "Shot", "500", "42"]), (P.word_delimiter(True), ["Wi-Fi"], ["Wi-Fi", "Wi", "Fi"]),
        (P.delimited_payload(), ["the|0.1", "fox"], ["the", "fox"]), (P.multiplexer(An.uppercase()), ["a", "B"], ["a", "B", "A"]), (P.remove_duplicates(), ["a", "a", "b", "a"], ["a", "b", "a"]),
        (P.normalize("german"), ["größe"], ["grose"]), (P.normalize("scandinavian"), ["blåbärsöl"], ["blåbærsøl"]), (P.normalize("width"), ["ＡＢ１"], ["AB1"]), (P.normalize("digits"), ["٣۴"], ["34"]), (P.normalize("arabic"), ["أحْمد"], ["احمد"]), (P.normalize("persian"), ["یک"], ["يك"]),
    ],
)
def test_filters(spark, step, tokens, want):
    assert spark.createDataFrame([(tokens,)], "a array<string>").select(step(F.col("a")).alias("x")).first().x == want


def test_other_tokens(spark):
    df = spark.createDataFrame([("Tokyo 東京都 x", ["the|0.1", "fox"])], "t string, a array<string>")
    r = df.select(P.bigrams_of_ideographs()(F.col("t")).alias("t"), P.payloads(F.col("a")).alias("p"), P.min_hash(2, 1)(F.col("a")).alias("m"), P.min_hash(2, 1)(F.reverse("a")).alias("n")).first()
    assert r.t == ["tokyo", "東京", "京都", "x"] and r.p == [0.1, None] and r.m == r.n and len(r.m) == 2


def test_http(spark):
    bodies = {"/a.json": b'{"id": 1}\n{broken\n{"id": 2}\n', "/b.json.gz": gzip.compress(b'{"id": 3}'), "/c.csv": b'id,t\r\n1,"a, b"\r\n2,\r\n'}

    class Pages(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(bodies[self.path])

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert sorted(r.id for r in web.copy_from(spark, [f"{at}/a.json", f"{at}/b.json.gz"], "id int").collect()) == [1, 2, 3]
        assert sorted((r.id, r.t) for r in web.copy_from(spark, [f"{at}/c.csv"], "id int, t string", "csv", empty_string_as_null=True).select("id", F.coalesce("t", F.lit("-")).alias("t")).collect()) == [(1, "a, b"), (2, "-")]
        assert sorted((r.id, r.t) for r in web.copy_from(spark, [f"{at}/c.csv"], "t string, id int", "csv").collect()) == [(1, "a, b"), (2, "")]
        with pytest.raises(Exception):  # noqa: B017
            web.copy_from(spark, [f"{at}/a.json"], "id int", fail_fast=True).collect()
    finally:
        server.shutdown()


def test_returning(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "k int, v int")
    assert [tuple(r) for r in dml.update_returning(t, F.col("v") > 15, {"v": F.col("v") + 1}).collect()] == [(2, 21)]
    new = spark.createDataFrame([(3, 1), (4, 2), (4, 2)], "k int, v int")
    assert [tuple(r) for r in dml.insert_returning(t, new, ["k"], "k").collect()] == [(4,)]


def test_session_functions(spark):
    r = spark.range(1).select(system.backend_pid(spark).alias("p"), system.postmaster_start_time(spark).alias("s"), system.user_by_id(F.lit(10)).alias("u"), system.function_result(spark, "upper").alias("f")).first()
    assert r.p > 0 and r.s.year > 2000 and r.u and "upper" in r.f.lower()


def test_json_arrays_keep_their_values(spark, tmp_path):
    import json

    from strataflow.sources import files

    rows = spark.sql("""select 'x,{},y' as t, map() as m, cast(null as string) as n, array(1, null) as a, named_struct('k', cast(null as int)) as o, '"v":{}' as q
    union all select '', map('a', 1), 'null', array(), named_struct('k', 1), null""")
    assert files.copy_to(rows.select("t", F.col("m").cast("map<string,int>").alias("m"), "n", "a", "o", "q"), str(tmp_path / "j"), "json_array") == 2
    got = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert sorted(got, key=str) == sorted([["x,{},y", {}, None, [1, None], {"k": None}, '"v":{}'], ["", {"a": 1}, "null", [], {"k": 1}, None]], key=str)


def test_addresses_and_identifiers(spark):
    from strataflow.functions import network

    cases = [("::1", "::/64", True), ("2001:db8::1", "2001:db8::/32", True), ("2001:db9::1", "2001:db8::/32", False), ("1.2.3.4", "::/0", False), ("1.2.3.4", "1.2.3.4", True), ("1:2:3:4:5:6:7:8", "1:2:3:4::/64", True), ("255.255.255.255", "0.0.0.0/0", True), ("::", "::/128", True), (None, "::/0", None)]
    df = spark.createDataFrame(cases, "ip string, net string, want boolean")
    assert df.where(~network.in_network(F.col("ip"), F.col("net")).eqNullSafe(F.col("want"))).collect() == []
    for bad in ("1.2.3", "256.1.1.1", "1:2:3", "1::2::3", "x", "1:2:3:4:5:6:7:8:9"):
        with pytest.raises(Exception, match="not an address"):
            spark.createDataFrame([(bad,)], "ip string").select(network.in_network(F.col("ip"), F.lit("::/0"))).collect()
    for bad in ("a.", "1a", "a b", '"a', ""):
        with pytest.raises(Exception, match="not a valid identifier"):
            spark.createDataFrame([(bad,)], "s string").select(network.parse_ident(F.col("s"))).collect()
    assert spark.createDataFrame([('A . "b.c" (x)',)], "s string").select(network.parse_ident(F.col("s"), False).alias("x")).first().x == ["a", "b.c"]


def test_versions_and_recovery(spark, tmp_path):
    from strataflow.operators import dml

    root = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        dml.read_version(spark, root)
    assert [dml.put_version(spark.range(n), root) for n in (1, 2, 3)] == [0, 1, 2]
    (tmp_path / "v" / "v3").mkdir()  # a version that was not finished does not count
    assert dml.read_version(spark, root).count() == 3 and not (tmp_path / "v" / "v0").exists()
    dml.replace_table(spark.range(4), str(tmp_path / "t"))
    (tmp_path / "t").rename(tmp_path / "t.old")
    assert dml.recover(spark, str(tmp_path / "t")) and spark.read.parquet(str(tmp_path / "t")).count() == 4
    twice = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], "k int, v int")
    a, b = (sorted(map(tuple, dml.one_each(twice.repartition(n), ["k"]).collect())) for n in (1, 3))
    assert a == b and len(a) == 2


def test_not_in_and_shapes_that_touch(spark):
    from strataflow.functions import geo
    from strataflow.operators import relational as R

    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r.k for r in R.not_in(a, "k", a.where("k = 1")).collect()] == [2]
    assert R.not_in(a, "k", a).count() == 0 and R.not_in(a, "k", a.where("false")).count() == 3
    cases = [("POINT (0 0)", "POINT (0 0)", True), ("POINT (0 0)", "POINT (0 1)", False), ("POINT (0 2)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", True), ("LINESTRING (5 0, 5 5)", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", False), ("POLYGON ((1 1, 2 1, 2 2, 1 1))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", True)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert df.where(geo.intersects(F.col("a"), F.col("b")) != F.col("want")).collect() == []
