"""Every query of the core against its SQL, on the smallest tables where they are at hand."""

import os

import pytest

import __spark_entry__
from docloom.plans import catalog

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")


def rows_of(frame):
    def cell(v):
        return "None" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, ROOT).toPandas()
    if name in catalog.SQL:
        want = duck.execute(catalog.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "chunk_id", "score", "normalized", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_are_what_they_should_be(spark):
    """Scans read the columns that are asked for, filters reach them, and ranks are limited before the shuffle."""
    plan = catalog.QUERIES["activity_metrics"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "raw_text" not in plan
    plan = catalog.QUERIES["keyword_topk"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "LeftSemi" in plan and "raw_text" not in plan
    plan = catalog.QUERIES["embeddings_of_docs"](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "vector" not in plan and "LeftSemi" in plan


@pytest.mark.parametrize("name", ["recent3", "rest_antijoin", "activity_timeline", "source_type_counts", "top5_projects", "status_counts", "document_labels", "cascade_delete", "global_documents", "discovery_search", "filtered_counts", "status_steps", "not_yet_known", "embeddings_of_docs"])
def test_texts_are_read_only_where_they_are_used(spark, name):
    """No scan of these reads a text, and none moves one."""
    plan = catalog.QUERIES[name](spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "ReadSchema" in x]
    assert scans and "raw_text" not in plan


def test_index_is_built_once_per_version(spark, tmp_path):
    from docloom.operators import keyword

    chunks = spark.createDataFrame([("c1", "p", "d", 0, "apple pie")], "id string, project_id string, doc_id string, start_char int, text string")
    folder, path = str(tmp_path / "index"), str(tmp_path / "chunks.parquet")
    chunks.write.parquet(path)
    version = keyword.version_of(spark, path)
    first = keyword.cached(spark.read.parquet(path), version, folder)
    # Another table under the same version is not looked at.
    again = keyword.cached(chunks.limit(0), version, folder)
    assert again.postings.count() == first.postings.count() == 2
    chunks.write.mode("append").parquet(path)
    assert keyword.version_of(spark, path) != version
