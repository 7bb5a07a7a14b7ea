"""Problem 6: texts packed into containers of a fixed number of tokens.

A grouping genetic algorithm: an individual is a packing, its genes are whole bins.
Crossover injects well-filled bins of one packing into another, drops the bins that then
hold an item twice, swaps displaced items into other bins where they fill them better, and
puts the rest back by best fit. Items are spread over
islands of a bounded number of items; on each, several populations evolve and exchange
their elite, and between epochs the well-filled bins of all islands are kept while the
items of the others move on to new islands.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

CAPACITY = 2_048
#: Items of an island; populations on it, packings in each, and generations at most.
ISLAND, POPULATIONS, PACKINGS, GENERATIONS = 1_000, 2, 6, 40
#: A bin filled to at least this share is kept between epochs.
ELITE = 0.995

#: Partitions that the islands are spread over at most, of some dozens of islands each or more.
SPREAD = 4_096

Packing = list[list[int]]


def best_fit(bins: Packing, items: list[int], size: list[int], capacity: int) -> Packing:
    """``items`` put into ``bins``, largest first, each where it leaves the least room; new bins where none fits."""
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in sorted(items, key=lambda i: -size[i]):
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        insort(room, (left - size[i], k))
    return bins


def fitness(packing: Packing, size: list[int], capacity: int) -> float:
    """The mean square of how full the bins are: few full bins beat many half-full ones."""
    return sum((sum(size[i] for i in b) / capacity) ** 2 for b in packing) / max(1, len(packing))


def replace(bins: Packing, loose: list[int], size: list[int], capacity: int) -> list[int]:
    """Items of ``bins`` swapped for larger ``loose`` ones that fill a bin better; what is loose then, in smaller items.

    One loose item takes the place of one or of two items of a bin.
    """
    pool = sorted((size[i], i) for i in loose)
    for x in bins:
        room = capacity - sum(size[i] for i in x)
        groups = [(i,) for i in x] + ([(i, j) for n, i in enumerate(x) for j in x[n + 1 :]] if len(x) <= 12 else [])
        best = None
        for g in groups if room else ():
            held = sum(size[i] for i in g)
            at = bisect_left(pool, (held + room + 1, -1)) - 1
            if at >= 0 and pool[at][0] > held and (best is None or pool[at][0] - held > best[0]):
                best = (pool[at][0] - held, at, g)
        if best:
            _, at, g = best
            _, new = pool.pop(at)
            for i in g:
                x.remove(i)
                insort(pool, (size[i], i))
            x.append(new)
    return [i for _, i in pool]


def crossover(a: Packing, b: Packing, size: list[int], capacity: int, rng: random.Random) -> Packing:
    """Well-filled bins of ``b`` injected into ``a``; what they displace is put back by best fit."""
    full = sorted(b, key=lambda x: -sum(size[i] for i in x))[: max(1, len(b) // 2)]
    genes = rng.sample(full, max(1, len(full) // 2))
    taken = {i for g in genes for i in g}
    kept, loose = [list(g) for g in genes], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in taken]
    # The emptiest bins are opened too, so that the displaced items find room.
    kept.sort(key=lambda x: -sum(size[i] for i in x))
    for _ in range(min(len(kept) - 1, max(1, len(kept) // 20))):
        loose += kept.pop()
    loose = replace(kept, loose, size, capacity)
    return best_fit(kept, loose, size, capacity)


def evolve(size: list[int], capacity: int = CAPACITY, seed: int = 1) -> Packing:
    """The best packing found of items 0, 1, ... of the given sizes, none above the capacity."""
    if not size:
        return []
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)

    def fresh() -> Packing:
        first = rng.sample(range(len(size)), rng.randint(0, len(size) // 3))
        return best_fit(best_fit([], first, size, capacity) if first else [], list(set(range(len(size))) - set(first)), size, capacity)

    score = lambda p: (len(p), -fitness(p, size, capacity))
    islands = [sorted([best_fit([], list(range(len(size))), size, capacity), *(fresh() for _ in range(PACKINGS - 1))], key=score) for _ in range(POPULATIONS)]
    for _ in range(GENERATIONS):
        if min(len(p[0]) for p in islands) == least:
            break
        for pop in islands:
            a, b = rng.sample(pop[:-1], 2) if len(pop) > 2 else (pop[0], pop[-1])
            pop[-1] = crossover(a, b, size, capacity, rng)
            pop.sort(key=score)
        elite = [p[0] for p in islands]
        for k, pop in enumerate(islands):
            pop[-1] = elite[k - 1]
            pop.sort(key=score)
    return min((p[0] for p in islands), key=score)


def items_of(sizes: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, start, tokens): what is packed. Only a text above the capacity is divided, into full parts and a rest."""
    part = F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / capacity)))
    start = F.col("part") * capacity
    return (
        sizes.where(F.col("tokens") > 0)
        .withColumn("part", part)
        .select(key, F.col("part").cast("int").alias("part"), start.alias("start"), F.least(F.lit(capacity), F.col("tokens") - start).cast("long").alias("tokens"))
    )


def pack(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, part, start, tokens, container): each text of ``sizes`` (key, tokens) with its container.

    ``start`` is the first token of the part in its text. Texts without tokens take no
    room and have no row, and so do null sizes. Keys must be distinct; ties are resolved
    by the key; columns other than ``key`` and ``tokens`` are left out.
    """
    items = cut_lineage(items_of(sizes, key, capacity))
    done = items.where(F.col("tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), key, "part"))
    left = items.where(F.col("tokens") < capacity)
    kept_columns = left.columns
    schema = f"{left.schema.simpleString()[7:-1]}, island int, bin int, filled long"

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "part"]).reset_index(drop=True)
        size = pdf["tokens"].tolist()
        bins = evolve(size, capacity)
        at = {i: (k, sum(size[j] for j in b)) for k, b in enumerate(bins) for i in b}
        pdf["bin"] = [at[i][0] for i in range(len(pdf))]
        pdf["filled"] = [at[i][1] for i in range(len(pdf))]
        return pdf[[*kept_columns, "island", "bin", "filled"]]

    for epoch in (1, 2):
        islands = max(1, -(-left.count() // ISLAND))
        spot = F.pmod(F.xxhash64(F.lit(epoch), key, "part"), F.lit(islands)).cast("int")
        # Few bytes and much to compute: a stated number of partitions isn't joined into one task.
        spread = left.withColumn("island", spot).repartition(min(islands, SPREAD), "island")
        out = cut_lineage(spread.groupBy("island").applyInPandas(lambda _, pdf: packed(pdf), schema))
        kept = out if epoch == 2 or islands == 1 else out.where(F.col("filled") >= ELITE * capacity)
        container = F.concat_ws("-", F.lit(str(epoch)), "island", "bin")
        done = done.unionByName(kept.withColumn("container", container).drop("island", "bin", "filled"))
        if kept is out:
            break
        left = out.where(F.col("filled") < ELITE * capacity).drop("island", "bin", "filled")
    return done


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, least, tokens, unused_share, fullest, emptiest): one row; ``least`` is the number that no packing can undercut."""
    by = packed.groupBy("container").agg(F.sum("tokens").alias("filled"))
    return by.agg(
        F.count(F.lit(1)).alias("containers"),
        F.ceil(F.coalesce(F.sum("filled"), F.lit(0)) / capacity).alias("least"),
        F.coalesce(F.sum("filled"), F.lit(0)).alias("tokens"),
        F.round(1 - F.coalesce(F.try_divide(F.sum("filled"), F.count(F.lit(1)) * capacity), F.lit(1.0)), 6).alias("unused_share"),
        F.max("filled").alias("fullest"),
        F.min("filled").alias("emptiest"),
    )
