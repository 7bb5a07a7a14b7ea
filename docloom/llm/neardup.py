"""Problem 3: near-duplicate texts by a chosen-path set similarity join.

Each text is the set of its word shingles, embedded by minwise hashing. In every tree a
node picks coordinates of the embedding, by a hash of the node itself, and sends its texts
to children by their values there; texts that share a path meet in a node. A node of few
texts is compared exhaustively, a larger one branches on, by two coordinates each time, so
that a pair that met so far is seldom lost. Trees are independent and repeated until a
pair at the threshold meets with the target recall. Compared is first on one-bit sketches,
then exactly on the shingles of the whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_WORD = re.compile(r"\w+")
#: Size of the minwise embedding, and bits of the sketch that is taken from it.
COORDINATES, SKETCH_BITS = 64, 256
#: Texts that a node compares exhaustively; a node above it branches as long as it can.
NODE = 512
#: Coordinates that a large node branches by: the least number not below 1 / threshold, for thresholds from one half.
BRANCHES = 2
#: Large nodes are broadcast up to so many rows of 16 bytes, beyond them joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Plan:
    """How deep trees begin and end, and how many of them there are."""

    width: int
    threshold: float
    recall: float
    first: int = 2
    last: int = 4

    @property
    def trees(self) -> int:
        """So many that a pair at the threshold meets in one of them, even if all nodes are large down to the last depth."""
        meet = self.threshold**self.first * (1 - (1 - self.threshold) ** BRANCHES) ** (self.last - self.first)
        return max(4, math.ceil(math.log(1 - self.recall) / math.log(1 - meet)))

    @property
    def keys(self) -> int:
        """Node keys of a text in one tree: a node of depth ``first`` and all below it."""
        return (BRANCHES ** (self.last - self.first + 1) - 1) // (BRANCHES - 1)

    @property
    def least(self) -> int:
        """Equal sketch bits below which a pair at the threshold falls in 1 of 1000 cases."""
        p = (1 + self.threshold) / 2
        return math.floor(SKETCH_BITS * p - 3.1 * math.sqrt(SKETCH_BITS * p * (1 - p)))


@lru_cache(maxsize=4)
def _mixers(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Distinct hashes of the word shingles of texts; words are hashed once per batch."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if len(words) < self.width:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode())
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - self.width + 1
        s = np.zeros(n, np.uint64)
        for i in range(self.width):
            s = mix(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        return np.unique(s)


def embed(shingles: np.ndarray) -> np.ndarray:
    """The minwise value of each coordinate, and of each sketch bit beyond them."""
    a, b = _mixers(COORDINATES + SKETCH_BITS)
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(out, ((shingles[i : i + 256, None] * a) ^ b).min(0), out=out)
    return out


def paths(values: np.ndarray, plan: Plan) -> np.ndarray:
    """(trees, keys) of node keys, each node before those below it: a node picks its coordinates by a hash of its key."""

    def child(key: np.ndarray, depth: int, branch: int) -> np.ndarray:
        pick = (mix(key + np.uint64(1 + depth * BRANCHES + branch)) % np.uint64(COORDINATES)).astype(int)
        return mix((key ^ mix(values[pick])) + np.uint64(branch))

    def below(key: np.ndarray, depth: int) -> list[np.ndarray]:
        return [key] + [k for b in range(BRANCHES if depth < plan.last else 0) for k in below(child(key, depth, b), depth + 1)]

    key = mix(np.arange(1, plan.trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for depth in range(plan.first):
        key = child(key, depth, 0)
    return np.stack(below(key, plan.first), 1)


_EMBEDDED_DDL = "t1 long, t2 long, sketch binary, paths array<long>"


def _embedded(plan: Plan):
    """(t1, t2, sketch, paths) of each text with shingles: the node keys of all trees, one tree after the other."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("sketch", pa.binary()), ("paths", pa.list_(pa.int64()))])

    def embedded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(plan.width)
        for batch in batches:
            who, sketches, keys = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                s = shingler(text)
                if len(s):
                    values = embed(s)
                    who.append(i)
                    sketches.append(np.packbits((mix(values[COORDINATES:]) & np.uint64(1)).astype(np.uint8)).tobytes())
                    keys.append(paths(values, plan).astype(np.int64).ravel())
            if who:
                t1, t2 = (batch.column(c).to_numpy()[who] for c in ("t1", "t2"))
                off = np.arange(len(who) + 1, dtype=np.int32) * len(keys[0])
                yield pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(off, np.concatenate(keys))], schema=schema)

    return embedded


_PAIRS_DDL = "a1 long, a2 long, b1 long, b2 long"


def _meet(plan: Plan):
    """Pairs within the nodes of a partition that is sorted by node; where rows have a side, pairs of both sides."""
    schema = pa.schema([(c, pa.int64()) for c in ("a1", "a2", "b1", "b2")])
    popcount = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.uint8)

    def close(t: np.ndarray, bits: np.ndarray, side: np.ndarray) -> np.ndarray:
        if side[0]:
            one, other = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
            a, b = np.repeat(one, len(other)), np.tile(other, len(one))
        else:
            a, b = np.triu_indices(len(t), 1)
        far = popcount[bits[a] ^ bits[b]].sum(1)
        hit = (SKETCH_BITS - far >= plan.least) & (t[a] != t[b]).any(1)
        return np.concatenate([t[a[hit]], t[b[hit]]], 1)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        empty = np.zeros((0, 4), np.int64)

        def pairs(node: np.ndarray, t: np.ndarray, bits: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
            edge = np.flatnonzero(np.diff(node)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(node)]])
            some = ends - starts > 1
            return [close(t[i:j], bits[i:j], side[i:j]) for i, j in zip(starts[some], ends[some])]

        def told(found: list[np.ndarray]) -> pa.RecordBatch:
            p = np.unique(np.concatenate([empty, *found]), axis=0)
            swap = (p[:, 0] > p[:, 2]) | ((p[:, 0] == p[:, 2]) & (p[:, 1] > p[:, 3]))
            p[swap] = p[swap][:, [2, 3, 0, 1]]
            return pa.RecordBatch.from_arrays([pa.array(p[:, i].copy()) for i in range(4)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            t = np.stack([batch.column("t1").to_numpy(), batch.column("t2").to_numpy()], 1)
            bits = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(len(node), -1)
            side = batch.column("side").to_numpy()
            if rest is not None:
                node, t, bits, side = (np.concatenate(x) for x in zip(rest, (node, t, bits, side)))
            last = int(np.searchsorted(node, node[-1]))
            rest = (node[last:], t[last:], bits[last:], side[last:])
            if last:
                yield told(pairs(node[:last], t[:last], bits[:last], side[:last]))
        if rest is not None:
            yield told(pairs(*rest))

    return met


def _alone(level: DataFrame) -> DataFrame:
    """Nodes whose rows all meet."""
    return level.select("node", "t1", "t2", "sketch", F.lit(0).cast("byte").alias("side"))


def _blocks(big: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes that are large at the last depth: pairs of blocks as nodes of their own.

    A node of n rows is cut into b = ceil(n / NODE) blocks, and every row goes to the b
    pairs of blocks that its own takes part in, so each pair of rows still meets and no
    task holds more than two blocks. Rows of two blocks stand on two sides and meet across
    only; rows of one block meet once, in the pair of the block with itself.
    """
    b = F.ceil(F.col("n") / NODE).cast("int")
    own = F.pmod(F.xxhash64("t1", "t2"), b).cast("int")
    return (
        big.join(sizes, "node")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), b - 1)))
        .withColumn("node", F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")))
        .withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).cast("byte"))
        .select("node", "t1", "t2", "sketch", "side")
    )


def candidate_pairs(texts: DataFrame, plan: Plan) -> DataFrame:
    """Distinct pairs (a1, a2, b1, b2) of ``texts`` (t1, t2, text) that meet and have close sketches.

    The nodes of depth ``plan.first`` are counted with partial sums; texts of nodes above
    ``NODE`` move on to the node's children and so on, and what is still large at the last
    depth is compared in blocks.
    """
    embedded = cut_lineage(texts.mapInArrow(_embedded(plan), _EMBEDDED_DDL).groupBy("t1", "t2").agg(F.first("sketch").alias("sketch"), F.first("paths").alias("paths")))
    tree = F.explode(F.sequence(F.lit(0), F.lit(plan.trees - 1)))
    level = embedded.withColumn("tree", tree).select(
        F.get("paths", F.col("tree") * plan.keys).alias("node"), F.slice("paths", F.col("tree") * plan.keys + 2, plan.keys - 1).alias("deeper"), "t1", "t2", "sketch"
    )
    small = []
    for depth in range(plan.first, plan.last + 1):
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > NODE)
        sizes = cut_lineage(sizes)
        n_large = sizes.count()
        if not n_large:
            small.append(_alone(level))
            break
        large = F.broadcast(sizes) if n_large <= BROADCAST_ROWS else sizes
        small.append(_alone(level.join(large, "node", "left_anti")))
        big = level.join(large.select("node"), "node", "left_semi")
        if depth == plan.last:
            small.append(_blocks(big, large))
            break
        part = (F.size("deeper") / BRANCHES).cast("int")
        children = [F.slice("deeper", 1 + b * part, part) for b in range(BRANCHES)]
        level = big.select(F.explode(F.array(*children)).alias("sub"), "t1", "t2", "sketch")
        level = cut_lineage(level.select(F.get("sub", F.lit(0)).alias("node"), F.slice("sub", F.lit(2), F.size("sub")).alias("deeper"), "t1", "t2", "sketch"))
    nodes = small[0]
    for more in small[1:]:
        nodes = nodes.unionByName(more)
    return nodes.repartition("node").sortWithinPartitions("node").mapInArrow(_meet(plan), _PAIRS_DDL).distinct()


def jaccard(width: int):
    """Exact similarity of two text columns on their word shingles."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        shingler, kept, out = Shingler(width), {}, []

        def of(text: str) -> np.ndarray:
            if text not in kept:
                if len(kept) > 2_000:
                    kept.clear()
                kept[text] = shingler(text)
            return kept[text]

        for x, y in zip(a, b):
            x, y = of(x), of(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(both / max(1, len(x) + len(y) - both))
        return pd.Series(out, dtype="float64")

    return similarity


def near_duplicates(
    df: DataFrame, key: str = "id", text: str = "raw_text", newest: str | Column | None = None, width: int = 5, threshold: float = 0.8, recall: float = 0.99
) -> tuple[DataFrame, DataFrame]:
    """Members (key, t1, t2, shingled) and links (a1, a2, b1, b2, similarity) between classes of equal texts.

    A class is a text, named by two 64-bit hashes; copies are members of one class and are
    compared once. Links join different texts of at least ``threshold``. Texts with fewer
    than ``width`` words are members that aren't ``shingled`` and have no links; null texts
    are no members. A key delivered
    twice counts once, with the text that is last by ``newest``.
    """
    t = F.col(text)
    hashed = df.where(F.col(key).isNotNull() & t.isNotNull()).select(F.col(key).alias("key"), F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2"), t.alias("text"), (F.lit(0) if newest is None else F.col(newest) if isinstance(newest, str) else newest).alias("age"))
    has_words = F.col("text").rlike(r"(?:[\p{L}\p{N}_]+[^\p{L}\p{N}_]+){%d}[\p{L}\p{N}_]" % (width - 1))
    members = (
        hashed.withColumn("shingled", has_words)
        .groupBy("key")
        .agg(F.max_by(F.struct("t1", "t2", "shingled"), F.struct("age", "t1", "t2")).alias("t"))
        .select("key", "t.*")
    )
    plan = Plan(width, threshold, recall)
    pairs = cut_lineage(candidate_pairs(hashed.select("t1", "t2", "text"), plan))
    needed = pairs.select(F.col("a1").alias("t1"), F.col("a2").alias("t2")).union(pairs.select("b1", "b2")).distinct()
    texts = hashed.select("t1", "t2", "text").join(needed, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = cut_lineage(texts)
    sides = [texts.select(F.col("t1").alias(f"{s}1"), F.col("t2").alias(f"{s}2"), F.col("text").alias(f"text_{s}")) for s in "ab"]
    links = (
        pairs.join(sides[0], ["a1", "a2"])
        .join(sides[1], ["b1", "b2"])
        .withColumn("similarity", jaccard(width)("text_a", "text_b"))
        .where(F.col("similarity") >= threshold)
        .select("a1", "a2", "b1", "b2", "similarity")
    )
    return members, links


def groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(key, group, links): connected groups by the smallest class, and each text's links to other texts.

    Labels spread over links with pointer jumping: each round a class takes the smallest
    label among itself, its neighbours and their labels' labels, so chains halve. Rounds
    end when no label changes; the count of changes is all that reaches the driver.
    """
    edges = links.select(*[F.struct(F.col(f"{s}1").alias("t1"), F.col(f"{s}2").alias("t2")).alias(s) for s in "ab"])
    edges = cut_lineage(edges.union(edges.select("b", "a")).toDF("a", "b").distinct())
    degree = edges.groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("links"))
    labels = cut_lineage(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("c").alias("b"), "label"), "b").groupBy(F.col("a").alias("c")).agg(F.min("label").alias("best"))
        jump = labels.select(F.col("c").alias("label"), F.col("label").alias("far"))
        new = labels.join(jump, "label", "left").join(near, "c", "left").select("c", F.least("label", "far", "best").alias("new"), "label")
        new = cut_lineage(new)
        if not new.where("new <> label").count():
            break
        labels = new.select("c", F.col("new").alias("label"))
    named = labels.join(degree, "c").select(F.col("c.t1").alias("t1"), F.col("c.t2").alias("t2"), "label", "links")
    out = members.join(named, ["t1", "t2"], "left")
    label = F.coalesce("label", F.struct("t1", "t2"))
    return out.select("key", F.hex(F.xxhash64(label["t1"], label["t2"])).alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def id_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller id first: all pairs of keys that a link or an equal text joins."""
    members = members.where("shingled")
    a = members.select(F.col("t1").alias("a1"), F.col("t2").alias("a2"), F.col("key").alias("x"))
    b = members.select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), F.col("key").alias("y"))
    across = links.join(a, ["a1", "a2"]).join(b, ["b1", "b2"]).select("x", "y")
    equal = a.join(b, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2"))).where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(equal).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
