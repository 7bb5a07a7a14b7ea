"""Vector search: exact cosine within a project, queries in blocks against all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(c: Column, dimension: Column | None = None) -> Column:
    """Vectors that can be compared: not null or empty, of the stated dimension, without NaN, not all zero."""
    ok = c.isNotNull() & (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & F.exists(c, lambda x: x != 0)
    return F.coalesce(ok & (F.size(c) == dimension) if dimension is not None else ok, F.lit(False))


def live_vectors(embeddings: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, project_id, model_name, dimension, vector): the latest usable vector of each chunk that exists."""
    good = embeddings.where(usable(F.col("vector"), F.col("dimension")))
    newest = good.groupBy("chunk_id", "model_name").agg(F.max_by(F.struct("dimension", "vector"), F.struct("created_at", "id")).alias("v"))
    place = chunks.select(F.col("id").alias("chunk_id"), "project_id").dropDuplicates(["chunk_id"])
    return newest.join(place, "chunk_id").select("chunk_id", "project_id", "model_name", "v.dimension", "v.vector")


#: Rows of a block of vectors, and of a block of queries.
ROWS, QUERIES = 16_384, 4_096


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, query_vectors: str = "vector") -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` vectors nearest to each query, of its project and model.

    ``queries`` has (query_id, project_id, model_name, vector). The score is (1 + cosine) / 2,
    rounded to six places; ties go to the smaller chunk id. A query that is given for
    several projects has the ``k`` best of them all. Vectors are cut into blocks of a
    bounded number of rows and the queries into blocks that meet each of them, so a project
    of any size is spread over tasks; each task keeps ``k`` per query.
    """
    keys = ["project_id", "model_name"]
    n_rows = vectors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("row_blocks"))
    n_queries = queries.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("query_blocks"))
    blocks = n_rows.join(n_queries, keys)
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = vectors.join(blocks, keys).withColumn("r", spot("chunk_id", "row_blocks")).withColumn("q", every("query_blocks")).select(*keys, "r", "q", F.col("chunk_id").alias("key"), "vector")
    left = queries.join(blocks, keys).withColumn("q", spot("query_id", "query_blocks")).withColumn("r", every("row_blocks")).select(*keys, "r", "q", F.col("query_id").alias("key"), F.col(query_vectors).alias("vector"))

    def nearest(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or rows.empty:
            return pd.DataFrame(columns=["query_id", "chunk_id", "score"])
        size = len(rows["vector"].iloc[0])
        asked = asked[asked["vector"].map(len) == size]
        ids = rows["key"].to_numpy(object)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        x = np.stack(rows["vector"].to_list()).astype(np.float64)[order]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out = []
        for i in range(0, len(asked), 256):
            part = asked.iloc[i : i + 256]
            q = np.stack(part["vector"].to_list()).astype(np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True)
            s = np.round((1 + q @ x.T) / 2, 6)
            # Stable and by id, so ties go to the smaller one.
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"query_id": np.repeat(part["key"].to_numpy(object), best.shape[1]), "chunk_id": ids[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}))
        return pd.concat(out) if out else pd.DataFrame(columns=["query_id", "chunk_id", "score"])

    cells = [*keys, "r", "q"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # queries may stem from the vectors
    found = left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(nearest, "query_id string, chunk_id string, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def merged(store: DataFrame, new: DataFrame) -> DataFrame:
    """A vector store after an upsert: by chunk and model the new vector wins, the latest of several, else the old one stays."""
    both = store.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in store.columns if c not in ("chunk_id", "model_name")]
    row = F.max_by(F.struct(*rest), F.struct("__new", "created_at", "id"))
    return both.groupBy("chunk_id", "model_name").agg(row.alias("v")).select("chunk_id", "model_name", "v.*").select(*store.columns)


def without(store: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """A vector store without the vectors of ``chunk_ids`` (chunk_id)."""
    return store.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_anti").select(*store.columns)
