"""Every registered query against the same query in DuckDB."""

import duckdb
import pytest

from strataflow.catalog import TABLES
from strataflow.plans import analytics, forms, registry, relational, scalars, statements  # noqa: F401


@pytest.fixture(scope="module")
def duck(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, folder, duck, name):
    df = registry.QUERIES[name](spark, folder)
    got = sorted([norm(r[c]) for c in sorted(df.columns)] for r in df.collect())
    if name not in registry.SQL:
        assert got
        return
    cur = duck.execute(registry.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted([norm(r[names.index(c)]) for c in sorted(names)] for r in cur.fetchall())
