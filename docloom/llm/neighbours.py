"""Problem 1: the k most similar vectors of every vector.

A hierarchical k-means tree is fitted on a bounded sample and sent to the executors; all
vectors are then placed in its leaves. A query descends the tree best bin first: a
priority queue holds the nodes met so far by the least similarity of a centre on the way to
them, the best one is opened, and leaves are visited until the best node left lies further below the best
leaf than a margin. The margin is widened on the sample until the recall asked for is
reached. Leaves are grouped into shards of a bounded number of rows, which are compared
with their visitors by matrix products; a shard above its size is split into blocks. A
vector is sent once to each shard it visits, with a bit for each leaf. If only neighbours
above a floor are asked for, they are few and near: a shard of which any leaf is visited is
then read whole, which needs fewer shards for the same recall. Without a floor far more is
visited, so shards are larger and vectors are sent to fewer of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors per model that the tree is fitted on, at most about so many; documented bound.
SAMPLE = 16_384
#: Rows of a leaf and of a shard that are aimed at, and visitors of a shard before it is split.
LEAF_ROWS, SHARD_ROWS, VISITORS = 512, 8_192, 32_768
#: How many times larger shards and their groups of visitors are without a floor.
WIDE = 4
BRANCHES = 8


@dataclass
class Tree:
    """A k-means tree as arrays. Node 0 is the root; ``leaf[i]`` is -1 for an inner node.

    ``lift`` is by how much a leaf's centre lies nearer to a vector than the centre of the
    inner node above it, on average; with it nodes of all levels compare in one queue.
    """

    centre: np.ndarray
    lift: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    shard: np.ndarray
    margin: float = 0.0

    def __post_init__(self) -> None:
        #: The number of each leaf within its shard.
        self.local = np.zeros(len(self.shard), np.int16)
        for k in range(int(self.shard.max()) + 1):
            mine = np.flatnonzero(self.shard == k)
            self.local[mine] = np.arange(len(mine))

    def leaves(self) -> np.ndarray:
        """The centres of the leaves in order of their number."""
        return self.centre[np.flatnonzero(self.leaf >= 0)]

    def visits(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves) of bool: the leaves that each unit vector visits, best bin first.

        The queue holds nodes by the least score on the way to them, equal ones inner nodes
        first and then leaves by their own score, and ends at the first that lies further
        below the best leaf so far than the margin. Leaves thus leave it in the order of
        the least score of their path, so the queues of all queries are worked through at
        once: by sorting, beside the best leaf before each one.
        """
        n, at = len(q), np.flatnonzero(self.leaf >= 0)
        if len(at) == 1:
            return np.ones((n, 1), bool)
        score = q @ self.centre.T + self.lift
        least = np.empty_like(score)
        least[:, 0] = np.inf
        for node, kids in enumerate(self.children):  # a node's children come after it
            if kids:
                least[:, kids] = np.minimum(score[:, kids], least[:, [node]])
        least, score = least[:, at], score[:, at]
        order = np.lexsort((-score, -least), axis=1)
        best = np.maximum.accumulate(np.take_along_axis(score, order, 1), axis=1)
        opened = np.ones((n, len(at)), bool)
        opened[:, 1:] = np.take_along_axis(least, order, 1)[:, 1:] >= best[:, :-1] - self.margin
        opened = np.logical_and.accumulate(opened, axis=1)
        seen = np.zeros((n, len(at)), bool)
        np.put_along_axis(seen, order, opened, 1)
        return seen

    def home(self, q: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the most similar leaf centre."""
        return (q @ self.leaves().T).argmax(1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, as floats."""
    x = x.astype(np.float64)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        a = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        length = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(length > 1e-9, s / np.maximum(length, 1e-9), x[rng.choice(len(x), k)])
    return c


def fit(sample: np.ndarray, leaves: int, shards: int, seed: int = 7) -> Tree:
    """A tree over unit vectors with about ``leaves`` leaves in about ``shards`` subtrees."""
    rng = np.random.default_rng(seed)
    leaf_size, shard_size = max(4.0, len(sample) / max(1, leaves)), len(sample) / max(1, shards)
    centre, children, leaf, shard, near = [sample.mean(0)], [[]], [-1], [-1], [0.0]
    stack, n_leaves, n_shards = [(0, np.arange(len(sample)))], 0, 0
    while stack:
        node, rows = stack.pop()
        if shard[node] < 0 and len(rows) <= 1.5 * shard_size:
            shard[node], n_shards = n_shards, n_shards + 1
        x = sample[rows]
        k = int(min(BRANCHES, np.ceil(len(rows) / leaf_size), np.ceil(len(rows) / shard_size) if shard[node] < 0 else BRANCHES))
        groups = []
        if len(rows) > 1.5 * leaf_size and k >= 2 and len(np.unique(x[:64], axis=0)) > 1:
            c = _kmeans(x, k, rng)
            a = (x @ c.T).argmax(1)
            groups = [(c[j], rows[a == j]) for j in range(k) if (a == j).any()]
        if len(groups) < 2:
            leaf[node], n_leaves = n_leaves, n_leaves + 1
            if shard[node] < 0:
                shard[node], n_shards = n_shards, n_shards + 1
            continue
        for c, sub in groups:
            children[node].append(len(centre))
            stack.append((len(centre), sub))
            centre.append(c)
            near.append(float((sample[sub] @ c).mean()))
            children.append([])
            leaf.append(-1)
            shard.append(shard[node])
    of = np.asarray(leaf)
    order = np.flatnonzero(of >= 0)
    of[order] = np.arange(len(order))
    level = np.asarray(near)
    lift = np.where(of >= 0, 0, level[order].mean() - level).astype(np.float32)
    return Tree(unit(np.asarray(centre) + 1e-12), lift, children, of, np.asarray(shard)[order])


def calibrate(tree: Tree, sample: np.ndarray, k: int, floor: float | None, recall: float, share: float = 1.0, seed: int = 11) -> float:
    """The least margin at which the visits of sample queries hold ``recall`` of their neighbours.

    With a floor the neighbours are drawn at exactly that similarity in a random direction
    (the hardest ones asked for), and a pair counts when either end visits a leaf in the
    other's shard; without one their leaf counts, and they are the best of the sample: as
    many of the k as fall to the sample, whose ``share`` of all vectors is given, for the
    sample's k best lie further away than the k best of all.
    """
    rng = np.random.default_rng(seed)
    q = sample[rng.choice(len(sample), min(512 if floor is not None else 2048, len(sample)), replace=False)]
    if floor is not None:
        noise = rng.normal(size=(len(q), 4, q.shape[1])).astype(np.float32)
        noise -= (noise * q[:, None]).sum(2, keepdims=True) * q[:, None]
        noise /= np.maximum(np.linalg.norm(noise, axis=2, keepdims=True), 1e-9)
        near = (floor * q[:, None] + np.sqrt(1 - floor**2) * noise).reshape(-1, q.shape[1])
        who = np.repeat(np.arange(len(q)), 4)
    else:
        s = q @ sample.T
        s[s > 1 - 1e-6] = -1
        k = max(1, int(np.ceil(k * share)))
        best = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
        near, who = sample[best.ravel()], np.repeat(np.arange(len(q)), best.shape[1])

    homes, own = tree.home(near), tree.home(q)[who]
    tree.margin = 0.02
    while True:
        if floor is None:
            seen = tree.visits(q)[who, homes]
        else:
            seen = _by_shard(tree, tree.visits(q))[who, tree.shard[homes]]
            seen |= _by_shard(tree, tree.visits(near))[np.arange(len(near)), tree.shard[own]]
        if seen.mean() >= recall or tree.margin > 2:
            return tree.margin
        tree.margin *= 1.15


def usable(df: DataFrame) -> DataFrame:
    """Rows whose vector is not null, of the stated dimension, without NaN and not all zero."""
    v = F.col("vector")
    return df.where(
        v.isNotNull()
        & F.col("chunk_id").isNotNull()
        & F.col("model_name").isNotNull()
        & (F.size(v) == F.col("dimension"))
        & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
        & F.exists(v, lambda x: x != 0)
    )


def _trees(rows: DataFrame, k: int, floor: float | None, recall: float) -> dict[str, Tree]:
    """A calibrated tree for each model and dimension, fitted on a sample of bounded size."""
    counts = {r.model: r.n for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    shard_rows, visitors = (SHARD_ROWS, VISITORS) if floor is not None else (WIDE * SHARD_ROWS, WIDE * VISITORS)
    part = F.lit(0.0)
    for model, n in counts.items():
        part = F.when(F.col("model") == model, min(1.0, SAMPLE / n)).otherwise(part)
    spot = F.pmod(F.xxhash64(F.lit(5), "a1", "a2"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    got = rows.where(spot < part).select("model", "vector").toPandas()
    out = {}
    for model, vectors in got.groupby("model")["vector"]:
        x = unit(np.stack(vectors.to_list()))
        n = counts[model]
        tree = fit(x, max(1, min(len(x) // 8, round(n / LEAF_ROWS))), max(1, round(n / shard_rows)))
        tree.margin = calibrate(tree, x, k, floor, recall, len(x) / n) if len(x) > 1 else 2.0
        homes = np.bincount(tree.home(x), minlength=len(tree.shard))
        held = np.bincount(tree.shard, weights=homes) * n / len(x)
        seen = np.zeros(len(held))
        for i in range(0, len(x), 2048):
            seen += _by_shard(tree, tree.visits(x[i : i + 2048])).sum(0)
        tree.blocks = np.maximum(1, np.ceil(held / (2 * shard_rows))).astype(int)
        tree.parts = np.maximum(1, np.ceil(seen * n / len(x) / visitors)).astype(int)
        out[model] = tree
    return out


def _by_shard(tree: Tree, seen: np.ndarray) -> np.ndarray:
    """(queries, shards) of bool: the shards with a leaf that is visited."""
    out = np.zeros((len(seen), int(tree.shard.max()) + 1), bool)
    for leaf, shard in enumerate(tree.shard):
        out[:, shard] |= seen[:, leaf]
    return out


_ROUTED = pa.schema(
    [("model", pa.string()), ("cell", pa.string()), ("a1", pa.int64()), ("a2", pa.int64()), ("indexed", pa.bool_()), ("home", pa.int16()), ("leaves", pa.binary()), ("v", pa.binary())]
)
_ROUTED_DDL = "model string, cell string, a1 long, a2 long, indexed boolean, home short, leaves binary, v binary"
_PAIRS_DDL = "model string, a1 long, a2 long, b1 long, b2 long, similarity double"
#: A neighbour as it is packed: (b1, b2, similarity).
_PACKED = np.dtype([("b1", "<i8"), ("b2", "<i8"), ("s", "<f8")])


def _route(trees: dict[str, Tree], whole: bool):
    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.asarray(batch.column("model").to_pylist(), object)
            a1, a2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a1", "a2"))
            lists = batch.column("vector")
            flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for model in set(models):
                tree, rows = trees.get(model), np.flatnonzero(models == model)
                if tree is None:
                    continue
                x = unit(np.stack([flat[off[r] : off[r + 1]] for r in rows]))
                for i in range(0, len(rows), 2048):
                    yield _place(tree, model, a1[rows[i : i + 2048]], a2[rows[i : i + 2048]], x[i : i + 2048], whole)

    return routed


def _place(tree: Tree, model: str, a1: np.ndarray, a2: np.ndarray, x: np.ndarray, whole: bool) -> pa.RecordBatch:
    """A row in its home shard, and one in each other shard (or block) that is visited.

    ``leaves`` has a bit for each leaf of the shard that the row visits, by the leaf's number
    within the shard; null stands for all of the shard.
    """
    home, seen = tree.home(x), tree.visits(x)
    seen[np.arange(len(x)), home] = True
    shards = _by_shard(tree, seen)
    bits = [np.packbits(seen[:, tree.shard == s], axis=1) for s in range(shards.shape[1])]
    raw = [v.tobytes() for v in x]
    out: dict[str, list] = {c: [] for c in ("cell", "row", "indexed", "home", "leaves")}

    def put(cell: str, i: int, indexed: bool, shard: int, visits: bool) -> None:
        told = b"" if not visits else None if whole else bits[shard][i].tobytes()
        for c, value in zip(out, (cell, i, indexed, int(tree.local[home[i]]), told)):
            out[c].append(value)

    for i in range(len(x)):
        own = int(tree.shard[home[i]])
        in_block, in_part = int(a2[i] % tree.blocks[own]), int(a2[i] % tree.parts[own])
        for part in range(tree.parts[own]):
            put(f"{own}/{in_block}/{part}", i, True, own, part == in_part)
        for shard in np.flatnonzero(shards[i]):
            part = int(a2[i] % tree.parts[shard])
            for block in range(tree.blocks[shard]):
                if shard != own or block != in_block:
                    put(f"{shard}/{block}/{part}", i, False, int(shard), True)
    rows = np.asarray(out["row"])
    return pa.RecordBatch.from_arrays(
        [pa.array([model] * len(rows)), pa.array(out["cell"]), pa.array(a1[rows]), pa.array(a2[rows]), pa.array(out["indexed"], pa.bool_()), pa.array(out["home"], pa.int16()), pa.array(out["leaves"], pa.binary()), pa.array([raw[r] for r in rows], pa.binary())],
        schema=_ROUTED,
    )


def _compare(k: int, floor: float):
    """Within one cell, of a shard that is read whole: the pairs of at least ``floor``."""

    def cell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["v"]), np.float32).reshape(len(pdf), -1)
        rows, a = np.flatnonzero(pdf["indexed"].to_numpy()), pdf[["a1", "a2"]].to_numpy()
        queries = np.flatnonzero(pdf["leaves"].isna().to_numpy())
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.float32))]
        for i in range(0, len(queries), 2048):
            for j in range(0, len(rows), 4096):
                q, y = queries[i : i + 2048], rows[j : j + 4096]
                found += _above(x[q] @ x[y].T, q, y, k, floor)
        p, r, _ = (np.concatenate(c) for c in zip(*found))
        apart = (a[p] != a[r]).any(1)
        p, r = p[apart], r[apart]
        out = pd.DataFrame({"model": key[0], "a1": a[p, 0], "a2": a[p, 1], "b1": a[r, 0], "b2": a[r, 1], "similarity": _exact(x, p, r)})
        out = out[out["similarity"] >= floor - 1e-7].drop_duplicates(["a1", "a2", "b1", "b2"])
        out = out.sort_values(["a1", "a2", "similarity"], ascending=[True, True, False])
        return out.groupby(["a1", "a2"], sort=False).head(k)

    return cell


def _exact(x: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Similarities in double precision of pairs that single precision chose."""
    return np.concatenate([np.einsum("ij,ij->i", x[p[i : i + 65536]].astype(np.float64), x[r[i : i + 65536]].astype(np.float64)) for i in range(0, len(p), 65536)] or [np.zeros(0)])


_NEAR = pa.schema([("model", pa.string()), ("a1", pa.int64()), ("a2", pa.int64()), ("near", pa.binary())])
_NEAR_DDL = "model string, a1 long, a2 long, near binary"


def _compare_full(k: int):
    """Within one cell: the k best rows of each query among the leaves it visits, packed in one value."""

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_numpy()
        a1, a2 = column("a1"), column("a2")
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), np.float32).reshape(len(a1), -1)
        p, r = _nearest(x, np.flatnonzero(column("indexed")), column("home"), np.array(table.column("leaves").to_pylist(), object), k)
        packed = np.empty(len(p), _PACKED)
        packed["b1"], packed["b2"], packed["s"] = a1[r], a2[r], _exact(x, p, r)
        asked, starts = np.unique(p, return_index=True)  # in order
        offsets = np.append(starts, len(p)).astype(np.int32) * _PACKED.itemsize
        near = pa.Array.from_buffers(pa.binary(), len(asked), [None, pa.py_buffer(offsets), pa.py_buffer(packed.tobytes())])
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(asked), pa.string()), pa.array(a1[asked]), pa.array(a2[asked]), near], schema=_NEAR)

    return cell


def _merge(k: int):
    """The k best of each query over all cells that it was in, a row each; ties go to the smaller hash."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("near").to_pylist()
            size = np.array([len(x) // _PACKED.itemsize for x in lists], int)
            packed, q = np.frombuffer(b"".join(lists), _PACKED), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((packed["b2"], packed["b1"], -packed["s"], q))
            order = order[np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size) < k]
            q, packed = q[order], packed[order]
            columns = [batch.column(c).take(pa.array(q)) for c in ("model", "a1", "a2")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(packed[c]) for c in ("b1", "b2", "s"))], names=["model", "a1", "a2", "b1", "b2", "similarity"])

    return merged


def _nearest(x: np.ndarray, rows: np.ndarray, home: np.ndarray, leaves: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the k best of each query among ``rows`` of the leaves it visits, itself left out.

    Leaf by leaf: a query's row of similarities is looked at only if one of them passes its k-th best so far.
    """
    asking = np.flatnonzero([len(b) > 0 for b in leaves])
    none = np.zeros(0, int)
    if not len(asking) or not len(rows):
        return none, none
    visits = np.unpackbits(np.frombuffer(b"".join(leaves[asking]), np.uint8).reshape(len(asking), -1), axis=1).astype(bool)
    best = np.full((len(asking), k), -np.inf, np.float32)
    which = np.full((len(asking), k), -1)
    rows = rows[np.argsort(home[rows], kind="stable")]
    number, starts = np.unique(home[rows], return_index=True)
    for leaf, mine in zip(number, np.split(rows, starts[1:])):
        at = np.flatnonzero(visits[:, leaf])
        y = x[mine].T
        for i in range(0, len(at), 4096):
            n = at[i : i + 4096]
            q = asking[n]
            s = x[q] @ y
            # A row of this leaf that asks itself.
            place = np.searchsorted(mine, q) if (np.diff(mine) > 0).all() else np.full(len(q), len(mine))
            place = np.minimum(place, len(mine) - 1)
            own = mine[place] == q
            s[np.flatnonzero(own), place[own]] = -np.inf
            hit = np.flatnonzero((s > best[n, -1:]).any(1))
            if not len(hit):
                continue
            all_s = np.concatenate([best[n[hit]], s[hit]], 1)
            all_r = np.concatenate([which[n[hit]], np.broadcast_to(mine, (len(hit), len(mine)))], 1)
            top = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
            values = np.take_along_axis(all_s, top, 1)
            order = np.argsort(-values, axis=1, kind="stable")
            best[n[hit]] = np.take_along_axis(values, order, 1)
            which[n[hit]] = np.take_along_axis(np.take_along_axis(all_r, top, 1), order, 1)
    p, c = np.nonzero(which >= 0)
    return asking[p], which[p, c]


def _best(s: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best columns of each row of ``s``."""
    if s.shape[1] <= k:
        c = np.broadcast_to(np.arange(s.shape[1]), s.shape)
    else:
        c = np.argpartition(-s, k - 1, axis=1)[:, :k]
    i = np.repeat(np.arange(len(s)), c.shape[1])
    c = c.ravel()
    return q[i], rows[c], s[i, c]


def _above(s: np.ndarray, q: np.ndarray, rows: np.ndarray, k: int, floor: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of at least ``floor``, for both of their ends, at most the k + 1 best of each end."""
    out = []
    for s, a, b in ((s, q, rows), (s.T, rows, q)):
        hit = s >= floor - 1e-5
        many = np.flatnonzero(hit.sum(1) > 4 * (k + 1))
        if len(many):
            out.append(_best(np.ascontiguousarray(s[many]), a[many], b, k + 1))
            hit[many] = False
        i, j = np.nonzero(hit)
        out.append((a[i], b[j], s[i, j]))
    return out


def similar_vectors(df: DataFrame, k: int = 10, floor: float | None = None, recall: float = 0.95) -> DataFrame:
    """(model_name, chunk_id, neighbour, similarity, rank): the k best of each usable vector.

    Rows delivered twice count once; of a chunk embedded again only the latest vector of a
    model counts. Equal vectors are compared once and share their neighbours; ties go to
    the smaller chunk id. With ``floor`` only neighbours of at least that cosine come out
    and the calibrated visits need to hold only those. Unusable vectors give no rows; an
    empty table gives none; other columns are left out.
    """
    rows = usable(df).select(
        F.concat_ws("/", "model_name", F.col("dimension").cast("string")).alias("model"),
        "model_name",
        "chunk_id",
        F.xxhash64("vector").alias("a1"),
        F.xxhash64(F.lit(1), "vector").alias("a2"),
        "vector",
        F.struct("created_at", "id").alias("age"),
    )
    live = rows.groupBy("model", "model_name", "chunk_id").agg(F.max_by(F.struct("a1", "a2"), "age").alias("at")).select("model", "model_name", "chunk_id", "at.*")
    trees = _trees(rows, k, floor, recall)
    first = Window.partitionBy("model", "a1", "a2").orderBy("chunk_id")
    leading = live.withColumn("copy", F.row_number().over(first)).where(F.col("copy") <= k + 1)
    vectors = (
        rows.groupBy("model", "a1", "a2")
        .agg(F.first("vector").alias("vector"))
        .join(live.select("model", "a1", "a2").distinct(), ["model", "a1", "a2"], "left_semi")
    )
    routed = vectors.mapInArrow(_route(trees, floor is not None), _ROUTED_DDL)
    cells = routed.groupBy("model", "cell")
    if floor is None:
        near = cells.applyInArrow(_compare_full(k), _NEAR_DDL)
        every = F.aggregate(F.collect_list("near"), F.lit(b""), lambda s, x: F.concat(s, x))
        near = near.groupBy("model", "a1", "a2").agg(every.alias("near")).mapInArrow(_merge(k), _PAIRS_DDL)
    else:
        # A pair is found from both of its ends.
        best = Window.partitionBy("model", "a1", "a2").orderBy(F.desc("similarity"), "b1", "b2")
        near = cells.applyInPandas(_compare(k, floor), _PAIRS_DDL).dropDuplicates(["model", "a1", "a2", "b1", "b2"])
        near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    others = leading.where(F.col("copy") <= k).select("model", F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("chunk_id").alias("neighbour"))
    apart = live.join(near, ["model", "a1", "a2"]).join(others, ["model", "b1", "b2"]).select("model", "model_name", "chunk_id", "neighbour", "similarity")
    copies = live.join(leading.select("model", "a1", "a2", F.col("chunk_id").alias("neighbour")), ["model", "a1", "a2"])
    copies = copies.where(F.col("chunk_id") != F.col("neighbour")).select("model", "model_name", "chunk_id", "neighbour", F.lit(1.0).alias("similarity"))
    rank = Window.partitionBy("model", "chunk_id").orderBy(F.desc("similarity"), "neighbour")
    found = apart.unionByName(copies).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return (found.where(F.col("similarity") >= floor) if floor is not None else found).drop("model")


def exact_neighbours(df: DataFrame, k: int = 10, every: int = 20, block: int = 16_384) -> DataFrame:
    """(model_name, chunk_id, neighbour, similarity) by brute force, to measure recall.

    The stated query set, every ``every``-th chunk by its id, meets all rows in blocks: a
    task holds about ``block`` rows and as many queries at most.
    """
    newest = F.max_by(F.struct("vector", "dimension"), F.struct("created_at", "id"))
    rows = usable(df).groupBy("model_name", "dimension", "chunk_id").agg(newest.alias("v")).select("model_name", "dimension", "chunk_id", "v.vector")
    number = F.coalesce(F.conv(F.substring("chunk_id", -8, 8), 16, 10).cast("long"), F.xxhash64("chunk_id"))
    n = rows.count()
    n_rows, n_queries = max(1, -(-n // block)), max(1, -(-n // (every * block)))
    parts = lambda count: F.explode(F.array(*[F.lit(i) for i in range(count)]))
    spot = lambda count: F.pmod(F.xxhash64("chunk_id"), F.lit(count)).cast("int")
    queries = rows.where(F.pmod(number, F.lit(every)) == 0).withColumn("q", spot(n_queries)).withColumn("r", parts(n_rows)).withColumn("query", F.lit(True))
    sides = queries.unionByName(rows.withColumn("r", spot(n_rows)).withColumn("q", parts(n_queries)).withColumn("query", F.lit(False)))

    def brute(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        q, r = np.flatnonzero(pdf["query"]), np.flatnonzero(~pdf["query"])
        x, ids, out = unit(np.stack(pdf["vector"].to_list())), pdf["chunk_id"].to_numpy(object), []
        for i in range(0, len(q) if len(r) else 0, 256):
            p, c, v = _best(x[q[i : i + 256]] @ x[r].T, q[i : i + 256], r, k + 1)
            out.append(pd.DataFrame({"model_name": key[2], "chunk_id": ids[p], "neighbour": ids[c], "similarity": v.astype(float)}))
        return pd.concat(out) if out else pd.DataFrame(columns=["model_name", "chunk_id", "neighbour", "similarity"])

    found = sides.groupBy("q", "r", "model_name", "dimension").applyInPandas(brute, "model_name string, chunk_id string, neighbour string, similarity double")
    best = Window.partitionBy("model_name", "chunk_id").orderBy(F.desc("similarity"), "neighbour")
    return found.where(F.col("chunk_id") != F.col("neighbour")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def recall_report(df: DataFrame, k: int = 10, recall: float = 0.95) -> DataFrame:
    """(model_name, queries, recall): the share of the exact k best that the tree search finds, on every 20th chunk."""
    exact = exact_neighbours(df, k)
    found = similar_vectors(df, k, recall=recall).select("model_name", "chunk_id", "neighbour", F.lit(1).alias("hit"))
    return (
        exact.join(found, ["model_name", "chunk_id", "neighbour"], "left")
        .groupBy("model_name")
        .agg(F.count_distinct("chunk_id").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
    )
