"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import RRF_K, rrf


def fuse(*lists: DataFrame, k: int = RRF_K, most: int | None = None) -> DataFrame:
    """(query_id, chunk_id, fused, rank) of lists (query_id, chunk_id, rank), in the order they rank by.

    A chunk's score is the sum over the lists that hold it. Ties go to the better rank in
    the first list, then in the next, then to the smaller id. One aggregation over the bag
    of all lists; no list is joined with another.
    """
    bag = reduce(lambda a, b: a.unionByName(b), [x.select("query_id", "chunk_id", "rank", F.lit(i).alias("of")) for i, x in enumerate(lists)])
    ranks = [F.min(F.when(F.col("of") == i, F.col("rank"))).alias(f"r{i}") for i in range(len(lists))]
    # By query, as the ranks need them: else rows move once for the sums and once for the ranks.
    fused = bag.repartition("query_id").groupBy("query_id", "chunk_id").agg(F.round(F.sum(rrf(F.col("rank"), k)), 6).alias("fused"), *ranks)
    best = Window.partitionBy("query_id").orderBy(F.desc("fused"), *[F.asc_nulls_last(f"r{i}") for i in range(len(lists))], "chunk_id")
    out = fused.withColumn("rank", F.row_number().over(best))
    return (out.where(F.col("rank") <= most) if most else out).select("query_id", "chunk_id", "fused", "rank")
