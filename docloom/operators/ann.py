"""Approximate vector search for large projects: vectors in lists around centres, of which a query reads the nearest.

A project of at most ``EXACT`` vectors of a model has one list, which every query reads, so
its results are exact. A larger one gets centres by k-means over a bounded sample of its
vectors; each vector lies in the list of its nearest centre, and a query reads the lists
whose centres are nearest to it until they hold the share of the sample's neighbours that
was asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Vectors of a project and model up to which search is exact.
EXACT = 50_000
#: Vectors of a list that are aimed at, and vectors of a project that its centres are fitted on; documented bounds.
LIST_ROWS, SAMPLE = 2_000, 20_000
#: Vectors and queries that a task compares at a time.
ROWS, QUERIES = 16_384, 4_096

_KEYS = ["project_id", "model_name"]


@dataclass(frozen=True)
class Index:
    """Centres (project_id, model_name, list, centre, probes) and vectors (project_id, model_name, list, chunk_id, vector)."""

    centres: DataFrame
    vectors: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _fitted(recall: float, k: int):
    """The centres of one project, and how many lists its queries read, from its sample."""

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = _unit(np.stack(pdf.sort_values("chunk_id")["vector"].to_list()).astype(np.float64)), int(pdf["n"].iloc[0])
        rng = np.random.default_rng(3)
        lists = 1 if n <= EXACT else max(2, min(len(x) // 8, round(n / LIST_ROWS)))
        c = x[rng.choice(len(x), lists, replace=False)]
        for _ in range(10 if lists > 1 else 0):
            near = (x @ c.T).argmax(1)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            c = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 1e-9, _unit(total), c)
        probes = 1
        if lists > 1:
            ask = rng.choice(len(x), min(400, len(x)), replace=False)
            s = x[ask] @ x.T
            s[np.arange(len(ask)), ask] = -2
            best = np.argpartition(-s, k, axis=1)[:, :k]
            order = np.argsort(np.argsort(-(x[ask] @ c.T), axis=1), axis=1)
            # The place that a neighbour's list has among the lists by nearness to the query.
            place = np.take_along_axis(order, (x @ c.T).argmax(1)[best], 1)
            probes = int(np.quantile(place, recall)) + 1
        return pd.DataFrame({"project_id": key[0], "model_name": key[1], "list": np.arange(lists), "centre": list(c), "probes": probes})

    return fit


def build(vectors: DataFrame, k: int = 10, recall: float = 0.95) -> Index:
    """The index of ``vectors`` (project_id, model_name, chunk_id, vector), usable ones of one length per model.

    Centres are fitted where a project's sample lies, a project at a time and at most
    ``SAMPLE`` vectors of it; every vector is then placed.
    """
    counts = vectors.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    spot = F.pmod(F.xxhash64(F.lit(9), "chunk_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # A small project is its own sample's first vectors only: it needs no more than one centre.
    part = F.when(F.col("n") <= EXACT, F.lit(64.0) / F.col("n")).otherwise(F.lit(float(SAMPLE)) / F.col("n"))
    first = vectors.groupBy(*_KEYS).agg(F.min_by(F.struct("chunk_id", "vector"), "chunk_id").alias("v")).select(*_KEYS, "v.*")
    sample = vectors.join(counts, _KEYS).where(spot < part).select(*_KEYS, "chunk_id", "vector")
    sample = sample.unionByName(first).dropDuplicates([*_KEYS, "chunk_id"]).join(counts, _KEYS)
    centres = cut_lineage(sample.groupBy(*_KEYS).applyInPandas(_fitted(recall, k), "project_id string, model_name string, list int, centre array<double>, probes int"))
    return Index(centres, _nearest_lists(vectors.withColumn("probes", F.lit(1)), centres, "chunk_id").withColumnRenamed("key", "chunk_id"))


def _nearest_lists(rows: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """(project_id, model_name, list, key, vector): each of ``rows`` in the lists nearest to it, ``probes`` of them or as many as the centres say."""
    counts = rows.groupBy(*_KEYS).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("blocks"))
    own = "probes" in rows.columns
    left = rows.join(counts, _KEYS).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).select(*_KEYS, "block", F.col(key).alias("key"), "vector", (F.col("probes") if own else F.lit(0)).alias("probes"))
    right = centres.join(counts, _KEYS).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*_KEYS, "block", "list", "centre", F.col("probes").alias("of_all"))

    def place(at: tuple, asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        columns = [*_KEYS, "list", "key", "vector"]
        if asked.empty or known.empty:
            return pd.DataFrame(columns=columns)
        c = np.stack(known["centre"].to_list())
        asked = asked[asked["vector"].map(len) == c.shape[1]].reset_index(drop=True)
        out = []
        for i in range(0, len(asked), 2_048):
            some = asked.iloc[i : i + 2_048]
            s = _unit(np.stack(some["vector"].to_list()).astype(np.float64)) @ c.T
            n = min(len(c), int(some["probes"].iloc[0]) or int(known["of_all"].iloc[0]))
            best = np.argsort(-s, axis=1, kind="stable")[:, :n]
            who = np.repeat(np.arange(len(some)), n)
            out.append(pd.DataFrame({"project_id": at[0], "model_name": at[1], "list": known["list"].to_numpy()[best].ravel(), "key": some["key"].to_numpy(object)[who], "vector": some["vector"].to_numpy(object)[who]}))
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    cells = [*_KEYS, "block"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInPandas(place, "project_id string, model_name string, list int, key string, vector array<float>")


def search(index: Index, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, chunk_id, score, rank): the ``k`` vectors nearest to each query (query_id, project_id, model_name, vector) among the lists it reads.

    The score is (1 + cosine) / 2, rounded to six places; ties go to the smaller chunk id. A
    list is compared in blocks, so a large one is spread over tasks.
    """
    from . import semantic

    asked = _nearest_lists(queries, index.centres, "query_id")
    # A list is a project of its own to the exact search, which cuts it and its queries into blocks.
    cell = F.concat_ws("\x00", "project_id", "list").alias("project_id")
    rows = index.vectors.select(cell, "model_name", "chunk_id", "vector")
    found = semantic.search(rows, asked.select(cell, "model_name", F.col("key").alias("query_id"), "vector"), k).drop("rank")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
