"""Every query of the engine against its SQL on the small tables."""

import os

import duckdb
import pytest

from tracewell.plans import registry

TABLES = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(TABLES):
        path = f"{TABLES}/{f}"
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(names, values):
    at = [names.index(c) for c in sorted(names)]
    plain = lambda v: v + 0.0 if isinstance(v, float) else v
    return sorted(repr([plain(r[i]) for i in at]) for r in values)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the small tables are not here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, TABLES)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert found == rows(want.columns, want.fetchall())


def test_registry():
    import __spark_entry__

    assert __spark_entry__.queries().keys() >= __spark_entry__.oracle_sql().keys()
