"""The registered queries that have SQL against it, on the smallest tables where they are at hand."""

import os

import pytest

from docloom.llm import queries

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, duck, name):
    got, want = queries.QUERIES[name](spark, ROOT).toPandas(), duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[sorted(f.columns)].astype(str).to_numpy()))
    assert rows(got) == rows(want)
