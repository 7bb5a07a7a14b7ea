import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import neighbours as nb

SCHEMA = "id string, chunk_id string, model_name string, dimension int, vector array<float>, created_at timestamp, cell string, a1 int"


def at(d):
    return dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)


def frame(rows, vectors, extra=()):
    data = [(f"e{i}", f"c{i:05d}", "m", len(v), [float(x) for x in v], at(1), "x", 1) for i, v in enumerate(vectors)]
    return rows(data + list(extra), SCHEMA)


def exact(x, k, floor=None):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(x)):
        best = sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]
        out[i] = [j for j in best if j != i and (floor is None or s[i, j] >= floor)]
    return out


def test_floor_finds_all_pairs(rows):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(scale=0.08, size=(60, 16))
    x = np.concatenate([base, near]).astype(np.float32)
    got = {(int(r.chunk_id[1:]), int(r.neighbour[1:])) for r in nb.similar_vectors(frame(rows, x), 10, floor=0.9, recall=0.99).collect()}
    want = {(i, j) for i, js in exact(x.astype(float), 10, 0.9).items() for j in js}
    assert len(want) > 80 and want == got


def test_recall_of_the_full_list(rows):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 24))[rng.integers(0, 40, 3000)] + rng.normal(scale=0.6, size=(3000, 24))).astype(np.float32)
    df = frame(rows, x)
    report = nb.recall_report(df, 10).collect()
    assert report[0].queries > 100 and report[0].recall >= 0.9


def test_copies_ties_and_deliveries(rows):
    v = [1.0, 0.0, 0.0]
    extra = [("e0", "c00000", "m", 3, v, at(2), "x", 1), ("o", "c00030", "m", 3, [0.0, 1.0, 0.0], at(3), "x", 1)]
    got = nb.similar_vectors(frame(rows, [v] * 31 + [[2.0, 0.1, 0.0]], extra), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert all(len(v) == 10 for v in by.values()) and len(by) == 32
    assert [r.neighbour for r in sorted(by["c00020"], key=lambda r: r.rank)] == [f"c{i:05d}" for i in range(10)]
    assert [r.neighbour for r in sorted(by["c00003"], key=lambda r: r.rank)] == [f"c{i:05d}" for i in range(11) if i != 3]
    # The chunk embedded again counts with its later vector only.
    assert all(r.similarity < 0.2 for r in by["c00030"])


def test_unusable_vectors(rows):
    nan = float("nan")
    bad = [("b1", "x1", "m", 2, None, None, None, None), ("b2", "x2", "m", 2, [], at(1), "x", 1), ("b3", "x3", "m", 2, [0.0, 0.0], at(1), "x", 1), ("b4", "x4", "m", 2, [nan, 1.0], at(1), "x", 1), ("b5", "x5", "m", 3, [1.0, 1.0], at(1), "x", 1), ("b6", "x6", "m", 2, [1.0, None], at(1), "x", 1), ("b7", None, "m", 2, [1.0, 1.0], at(1), "x", 1), ("b8", "x8", None, 2, [1.0, 1.0], at(1), "x", 1), ("b9", "x9", "k", 2, [1.0, 0.0], at(1), "x", 1)]
    got = nb.similar_vectors(frame(rows, [[1.0, 0.0], [0.0, 1.0]], bad), 10).collect()
    assert {(r.chunk_id, r.neighbour) for r in got} == {("c00000", "c00001"), ("c00001", "c00000")}
    assert nb.similar_vectors(frame(rows, []), 10).count() == 0


def test_shards_are_split_and_parts_cover(monkeypatch, rows):
    monkeypatch.setattr(nb, "SHARD_ROWS", 40)
    monkeypatch.setattr(nb, "VISITORS", 50)
    monkeypatch.setattr(nb, "LEAF_ROWS", 20)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(scale=0.02, size=(200, 8)) + 1, rng.normal(size=(100, 8))]).astype(np.float32)
    got = {}
    for r in nb.similar_vectors(frame(rows, x), 3, recall=0.999).collect():
        got.setdefault(int(r.chunk_id[1:]), set()).add(int(r.neighbour[1:]))
    want = exact(x.astype(float), 3)
    hit = sum(len(got.get(i, set()) & set(w)) for i, w in want.items()) / sum(map(len, want.values()))
    assert hit >= 0.95 and all(len(v) == 3 for v in got.values())


def test_tree_visits_widen():
    rng = np.random.default_rng(4)
    x = nb.unit(rng.normal(size=(2000, 12)))
    tree = nb.fit(x, 40, 5)
    assert len(tree.shard) > 10 and sorted(set(tree.shard)) == list(range(tree.shard.max() + 1))
    shares = []
    for tree.margin in (0.0, 0.3, 3.0):
        shares.append(tree.visits(x[:200]).mean())
    assert shares[0] < shares[1] < shares[2] == 1.0


def test_nearest_within_a_cell_is_exact_on_visited_leaves():
    rng = np.random.default_rng(5)
    x = nb.unit(rng.normal(size=(400, 8)))
    home = rng.integers(0, 7, 400).astype(np.int16)
    seen = rng.random((400, 7)) < 0.5
    leaves = np.empty(400, object)
    for i in range(400):
        leaves[i] = np.packbits(seen[i]).tobytes() if i % 3 else b""
    rows = np.flatnonzero(np.arange(400) % 4 != 1)
    p, r = nb._nearest(x, rows, home, leaves, 5)
    got = {}
    for a, b in zip(p, r):
        got.setdefault(int(a), set()).add(int(b))
    for q in range(400):
        can = [j for j in rows if j != q and seen[q, home[j]]] if q % 3 else []
        want = sorted(can, key=lambda j: -float(x[q] @ x[j]))[:5]
        assert got.get(q, set()) == set(map(int, want))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_many_shards_on_the_tables(spark, monkeypatch):
    monkeypatch.setattr(nb, "SHARD_ROWS", 48)
    monkeypatch.setattr(nb, "LEAF_ROWS", 24)
    df = spark.read.parquet("/root/testdata/sf0.01/chunk_embeddings.parquet")
    rows = nb.usable(df).select(F.concat_ws("/", "model_name", F.col("dimension").cast("string")).alias("model"), F.xxhash64("vector").alias("a1"), F.xxhash64(F.lit(1), "vector").alias("a2"), "vector")
    trees = nb._trees(rows, 10, None, 0.95)
    assert max(int(t.shard.max()) + 1 for t in trees.values()) >= 8
    report = {r.model_name: r for r in nb.recall_report(df, 10).collect()}
    assert len(report) == 2 and all(r.recall >= 0.9 for r in report.values())


def test_brute_force_takes_the_latest_vector(rows):
    extra = [("e0", "c00000", "m", 2, [0.0, 1.0], at(2), "x", 1)]
    got = nb.exact_neighbours(frame(rows, [[1.0, 0.0], [1.0, 0.1], [0.1, 1.0]], extra), 1, every=1).collect()
    assert {(r.chunk_id, r.neighbour) for r in got} == {("c00000", "c00002"), ("c00001", "c00002"), ("c00002", "c00000")}


def test_visits_are_those_of_a_queue():
    import heapq

    rng = np.random.default_rng(9)
    x = nb.unit(rng.normal(size=(1500, 10)))
    tree = nb.fit(x, 60, 4)
    for tree.margin in (0.05, 0.2, 0.5):
        got = tree.visits(x[:120])
        score = x[:120] @ tree.centre.T + tree.lift
        for i in range(120):
            queue, best, want = [(-np.inf, False, 0.0, 0)], -np.inf, set()
            while queue:
                value, is_leaf, _, node = heapq.heappop(queue)
                if -value < best - tree.margin:
                    break
                if is_leaf:
                    want.add(int(tree.leaf[node]))
                    best = max(best, score[i, node])
                for kid in tree.children[node]:
                    heapq.heappush(queue, (-min(-value, score[i, kid]), bool(tree.leaf[kid] >= 0), -score[i, kid], kid))
            assert set(np.flatnonzero(got[i])) == want
