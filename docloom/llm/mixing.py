"""Problem 7: sources mixed to target weights by Pareto order sampling.

A source's share of the mixture, over what it holds, is a number of copies. The whole
copies are certain for each of its documents; the rest is a sample without repeats in the
order of the ratio of two odds, those of a random number over those of the document's
probability of inclusion, cut where the source's size is reached. A document whose
probability would pass one is certain as well, and the others share what is left. The cut
is found from sums over bins of the order, so no source is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Bins of the sampling order in which the cut is looked for.
BINS = 4_096
#: Parts that documents of one source and size are ranked in first, before their best ones are.
SALTS = 64
#: Rows that are sent to all tasks at most.
MOST_SENT = 100_000


def source_name(c: Column | str) -> Column:
    """The spelling that a source's names have in common: lower case, trimmed, ``-`` for ``_``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(F.trim(c)), "_", "-")


def demands(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target: (source, target_share, max_repeats, documents, tokens, wanted, whole, part).

    ``wanted`` is the size that the source adds: its share of ``total`` among the sources
    that hold anything, at most ``max_repeats`` times what it holds. Without a ``total``
    it is the largest one at which every source that holds anything can keep its share.
    ``whole`` copies are certain; ``part`` is the size of the sample beside them.
    """
    held = sizes.where(F.col("tokens") > 0).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("tokens")
    )
    named = targets.where(F.col("source").isNotNull() & (F.col("target_share") > 0)).groupBy(source_name("source").alias("source")).agg(
        F.sum("target_share").alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).cast("long").alias("max_repeats")
    )
    rows = named.join(held, "source", "left").fillna(0, ["documents", "tokens"])
    every = Window.partitionBy()  # one row per target
    can = F.col("tokens") * F.col("max_repeats")
    share = F.when(can > 0, F.try_divide(F.col("target_share"), F.sum(F.when(can > 0, F.col("target_share"))).over(every))).otherwise(0.0)
    rows = rows.withColumn("share", share)
    most = F.floor(F.min(F.when(can > 0, can / F.col("share"))).over(every)) if total is None else F.lit(total)
    rows = rows.withColumn("wanted", F.coalesce(F.least(F.round(most * F.col("share")), can), F.lit(0)).cast("long"))
    whole = F.coalesce(F.floor(F.try_divide("wanted", "tokens")), F.lit(0)).cast("long")
    return rows.withColumn("whole", whole).withColumn("part", F.col("wanted") - F.col("whole") * F.col("tokens")).drop("share")


def inclusion(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, certain, rate): how the sample of each source in ``wanted`` (source, part) is drawn.

    A document's probability of inclusion is its size times ``rate``, so that the sample has
    the size ``part`` on average whatever its documents' lengths; documents of at least
    ``certain`` tokens would pass a probability of one, so they are in the sample and the
    rate is that of the rest. Found from the counts of each size, of which a source has at
    most as many as its longest text has tokens.
    """
    t = F.col("tokens").cast("double")
    held = sizes.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).join(wanted.where("part > 0").select("source", "part"), "source")
    above = Window.partitionBy("source").orderBy(F.desc("tokens")).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy(F.desc("tokens")).rowsBetween(0, Window.unboundedFollowing)
    rows = held.withColumn("sure", F.coalesce(F.sum(F.col("n") * t).over(above), F.lit(0.0))).withColumn("squares", F.sum(F.col("n") * t * t).over(below))
    rows = rows.withColumn("rate", F.greatest(F.lit(0.0), F.col("part") - F.col("sure")) / F.col("squares"))
    # The largest size whose probability stays below one once all larger ones are certain.
    first = rows.where(F.col("rate") * t < 1).groupBy("source").agg(F.max_by(F.struct("tokens", "rate"), "tokens").alias("f"))
    return first.select("source", (F.col("f.tokens") + 1).alias("certain"), F.col("f.rate").alias("rate"))


def _order(seed: int, key: str) -> Column:
    """The sampling order in [0, 1): the odds of a random number over the odds of inclusion, as a probability; certain documents come first."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.greatest(F.lit(1e-12), F.col("tokens") * F.col("rate"))
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(F.col("tokens") >= F.col("certain"), 0.0).otherwise(q / (1 + q))


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", total: int | None = None, seed: int = 1) -> DataFrame:
    """(key, source, tokens, copies): the documents of the mixture and how often each is used.

    ``sizes`` has distinct keys with ``source`` and ``tokens``; sources are brought to one
    spelling. Documents without tokens or of a source without a target are left out; a
    source without documents adds nothing. The sample of a source ends before the
    document that would pass its size; all later ones that fit, in order, fill up the rest.
    """
    sizes = sizes.where((F.col("tokens") > 0) & F.col("source").isNotNull()).select(key, source_name("source").alias("source"), "tokens")
    # Tables of a row per target are sent to all tasks, if they are small.
    send = F.broadcast if targets.count() <= MOST_SENT else lambda df: df
    wanted = demands(sizes, targets, total)
    asked = wanted.select("source", "whole", "part").join(inclusion(sizes, wanted), "source", "left").fillna({"certain": 1, "rate": 0.0})
    docs = sizes.join(send(asked), "source").withColumn("order", _order(seed, key))
    docs = cut_lineage(docs.withColumn("bin", F.when(F.col("tokens") >= F.col("certain"), -1).otherwise(F.floor(F.col("order") * BINS)).cast("int")))
    # At most BINS sums a source; the cut lies in the first bin that passes the part, and only that bin is sorted.
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = docs.groupBy("source", "bin").agg(F.sum("tokens").alias("size"), F.first("part").alias("part"))
    bins = bins.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).where(F.col("before") + F.col("size") > F.col("part"))
    cut = bins.groupBy("source").agg(F.min(F.struct(F.col("bin").alias("cut"), "before")).alias("at")).select("source", "at.*")
    docs = docs.join(send(cut), "source", "left")
    at_cut = F.coalesce(F.col("bin") == F.col("cut"), F.lit(False))
    apart = docs.where(~at_cut).withColumn("extra", F.when((F.col("part") > 0) & F.coalesce(F.col("bin") < F.col("cut"), F.lit(True)), 1).otherwise(0))
    within = Window.partitionBy("source").orderBy("order", key).rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("tokens").over(within), F.lit(0))
    open_bins = docs.where(at_cut).withColumn("extra", F.when(upto + F.col("tokens") <= F.col("part"), 1).otherwise(0))
    docs = cut_lineage(open_bins.unionByName(apart).drop("before", "cut"))
    docs = docs.join(_fill(docs, key, send), key, "left")
    out = docs.withColumn("copies", (F.col("whole") + F.col("extra") + F.coalesce("filled", F.lit(0))).cast("int"))
    return out.where(F.col("copies") > 0).select(key, "source", "tokens", "copies")


def _fill(docs: DataFrame, key: str, send: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, filled): the documents behind the cut, in order, that still fit a source's size, and one that passes it if that is nearer.

    A long document at the cut would leave a gap as long as itself. Of the documents of one
    size at most as many fit as the size goes into the gap, and of equal ones the first in
    order do, so no more of each size are looked at: gap * ln(gap) documents a source at
    most, whatever the source holds. The gap is shorter than the document at the cut.
    """
    gap = docs.groupBy("source").agg((F.first("part") - F.sum(F.col("extra") * F.col("tokens"))).alias("gap"))
    after = docs.where("extra = 0").join(send(gap), "source").where(F.col("tokens") < 2 * F.col("gap"))
    after = after.select("source", key, "order", "tokens", "gap", F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("salt"))
    for part in (["source", "tokens", "salt"], ["source", "tokens"]):
        first = Window.partitionBy(*part).orderBy("order", key)
        after = after.withColumn("n", F.row_number().over(first)).where(F.col("n") <= F.floor(F.col("gap") / F.col("tokens")) + 1)
    kind = dict(docs.dtypes)[key]

    def taken(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", key])
        gap, keys, over = float(pdf["gap"].iloc[0]), [], []
        for k, t in zip(pdf[key], pdf["tokens"]):
            if t <= gap:
                gap -= t
                keys.append(k)
            else:
                over.append((t, k))
        # The smallest of those that pass the size, if that brings the source nearer to it.
        over = [x for x in over if x[0] > gap]
        if over and min(over)[0] < 2 * gap:
            keys.append(min(over)[1])
        return pd.DataFrame({key: keys, "filled": 1})

    return after.drop("salt", "n").groupBy("source").applyInPandas(lambda _, pdf: taken(pdf), f"`{key}` {kind}, filled int")


def mixture_report(mixed: DataFrame, sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, actual_share, wanted_tokens, actual_tokens, documents, most_copies, max_repeats), a row per target."""
    named = sizes.where(F.col("source").isNotNull()).withColumn("source", source_name("source"))
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("used"), F.max("copies").alias("most_copies"))
    rows = demands(named, targets, total).join(got, "source", "left").fillna(0, ["actual_tokens", "used", "most_copies"])
    share = F.coalesce(F.try_divide(F.col("actual_tokens"), F.sum("actual_tokens").over(Window.partitionBy())), F.lit(0.0))
    return rows.select(
        "source", F.round("target_share", 6).alias("target_share"), F.round(share, 6).alias("actual_share"), F.col("wanted").alias("wanted_tokens"), "actual_tokens", F.col("used").alias("documents"), "most_copies", "max_repeats"
    )
