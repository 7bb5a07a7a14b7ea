"""Score expressions of retrieval."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion.
RRF_K = 60


def sigmoid(x: Column) -> Column:
    """The logistic function; it saturates at 0 and 1 in double precision."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def similarity_from_distance(distance: Column) -> Column:
    """A cosine distance (0 to 2) as a similarity (1 to 0)."""
    return 1 - distance / 2


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of equal length, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of equal length; null if either is all zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rrf(rank: Column, k: int = RRF_K) -> Column:
    """What a rank adds in reciprocal rank fusion."""
    return F.lit(1.0) / (F.lit(k) + rank)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two word sets; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)
