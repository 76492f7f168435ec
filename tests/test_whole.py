"""Registered queries over whole tables: every row of the input is in the result."""

import gzip
import http.server
import threading

import pytest
from pyspark.sql import functions as F

from strataflow.functions import geo
from strataflow.plans import forms, registry, relational, scalars  # noqa: F401
from strataflow.sources import web


@pytest.mark.parametrize("name", ["table_expand_array", "table_generate_subscripts"])
def test_every_vector_is_expanded(spark, folder, name):
    want = {r.vec_id: len(r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    got = registry.QUERIES[name](spark, folder).groupBy("vec_id").count().collect()
    assert {r.vec_id: r["count"] for r in got} == want and len(want) > 5


def test_within_takes_edges_in(spark):
    box, holed = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"
    cases = [(f"POINT ({x} {y})", box, 0 <= x <= 4 and 0 <= y <= 4) for x in range(-1, 6) for y in range(-1, 6)]
    cases += [(f"POINT ({x} {y})", holed, not (1 < x < 3 and 1 < y < 3)) for x in range(5) for y in range(5)]
    cases += [(f"POINT ({x} {y})", "POLYGON ((0 0, 3 9, 9 3, 0 0))", y <= 3 * x and x <= 3 * y and x + y <= 12) for x in range(10) for y in range(10)]
    cases += [
        ("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", box, True), (box, box, True), ("POLYGON ((2 2, 6 2, 6 4, 2 4, 2 2))", box, False),
        ("POLYGON ((0.5 0.5, 3.5 0.5, 3.5 3.5, 0.5 3.5, 0.5 0.5))", holed, False), ("POLYGON ((0 0, 1 0, 1 4, 0 4, 0 0))", holed, True),
        ("LINESTRING (0 0, 4 4)", box, True), ("LINESTRING (0 0, 4 4)", holed, False), ("LINESTRING (0 4, 4 4)", box, True),
        ("LINESTRING (0 4, 4 4)", "POLYGON ((0 0, 4 0, 4 4, 2 1, 0 4, 0 0))", False),
    ]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert [r.asDict() for r in df.where(geo.within(F.col("a"), F.col("b")) != F.col("want")).collect()] == []


def test_every_supplier_is_placed(spark, folder):
    rows = spark.read.parquet(f"{folder}/supplier.parquet").collect()
    got = {r.s_suppkey: r.inside for r in registry.QUERIES["geo_within"](spark, folder).collect()}
    assert got == {r.s_suppkey: 1 <= r.s_suppkey % 10 <= 3 and 1 <= r.s_nationkey <= 20 for r in rows}


def test_all_gzip_members_are_read(spark, monkeypatch):
    parts = [b'{"id": 1}\n{"id"', b': 2}\n', b"", b'{"id": 3}']
    packed = b"".join(map(gzip.compress, parts))
    assert all(b"".join(web.unpacked(packed[i : i + n] for i in range(0, len(packed), n))) == b"".join(parts) for n in (1, 2, 7, 20, 1 << 20))
    assert b"".join(web.unpacked([packed, b"\0" * 9])) == b"".join(parts)
    bodies = {"/all.gz": packed, "/cut.gz": packed[:-9], "/garbled.gz": packed + b"more"}

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
        for chunk in (1 << 20, 3):
            monkeypatch.setattr(web, "CHUNK", chunk)
            assert list(web.streamed(f"{at}/all.gz", 9)) == [b'{"id": 1}', b'{"id": 2}', b'{"id": 3}']
        assert sorted(r.id for r in web.copy_from(spark, [f"{at}/all.gz"], "id int").collect()) == [1, 2, 3]
        for name in ("cut", "garbled"):
            with pytest.raises(Exception, match="cut short|header check"):
                web.copy_from(spark, [f"{at}/{name}.gz"], "id int").collect()
    finally:
        server.shutdown()


@pytest.mark.parametrize(("name", "tables"), [("copy_json_round_trip", ["customer"]), ("copy_csv_round_trip", ["part"]), ("union_types", ["nation", "supplier"])])
def test_every_row_comes_back(spark, folder, name, tables):
    assert len(registry.QUERIES[name](spark, folder).collect()) == sum(spark.read.parquet(f"{folder}/{t}.parquet").count() for t in tables)
