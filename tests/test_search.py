import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docloom.operators import fusion, keyword, rerank, semantic
from docloom.plans import search

CHUNKS = [("c1", "p", "d1", 0, "apple pie apple"), ("c2", "p", "d1", 9, "apple tart"), ("c3", "p", "d2", 0, "apple cherry cake"), ("x1", "q", "d9", 0, "apple")]
SCHEMA = "id string, project_id string, doc_id string, start_char int, text string"


def by_hand(texts, query):
    docs = [t.split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query) for d in docs]


def test_bm25_with_common_and_repeated_words(rows):
    chunks = rows([*CHUNKS, CHUNKS[0]], SCHEMA)
    queries = rows([("q1", "p", "apple apple tart"), ("q2", "p", "nothing"), ("q3", "p", None)], "query_id string, project_id string, text string")
    got = {r.chunk_id: r.score for r in keyword.scores(keyword.build(chunks), queries).collect()}
    want = by_hand([c[4] for c in CHUNKS[:3]], ["apple", "apple", "tart"])
    assert set(got) == {"c1", "c2", "c3"} and all(abs(got[c[0]] - w) < 1e-6 for c, w in zip(CHUNKS, want))


def test_search_ties_and_isolation(rows):
    chunks = rows([("b", "p", "d2", 0, "moss fern"), ("a", "p", "d1", 5, "moss fern"), ("c", "p", "d1", 1, "moss fern"), ("z", "p", "d3", 0, "rock rock"), ("y", "p", "d3", 1, "rock"), ("w", "p", "d3", 2, "sand"), ("v", "p", "d3", 3, "clay")], SCHEMA)
    queries = rows([("q1", "p", "moss"), ("q2", "other", "moss")], "query_id string, project_id string, text string")
    got = keyword.search(keyword.build(chunks), queries, 2).orderBy("rank").collect()
    assert [(r.query_id, r.chunk_id, r.rank, r.normalized) for r in got] == [("q1", "c", 1, 1.0), ("q1", "a", 2, 1.0)]


def test_an_index_has_a_row_per_word_and_cell(rows, monkeypatch):
    """Not one per word and chunk, and a cut into many cells and parts finds the same."""
    words = ["moss", "fern", "rock", "sand"]
    chunks = rows([(f"c{i:02d}", "p", f"d{i % 5}", i, " ".join(words[: 1 + i % 4] * (1 + i % 3))) for i in range(40)], SCHEMA)
    queries = rows([(f"q{i}", "p", f"{words[i % 4]} {words[i % 3]} clay") for i in range(9)], "query_id string, project_id string, text string")
    index = keyword.build(chunks)
    assert index.postings.count() == 4
    whole = sorted(keyword.search(index, queries, 5).collect())
    for name, value in (("CHUNKS", 4), ("TOGETHER", 2), ("QUERIES", 3)):
        monkeypatch.setattr(keyword, name, value)
    index = keyword.build(chunks)
    assert index.cells.count() > 4 and sorted(keyword.search(index, queries, 5).collect()) == whole
    best = {}
    for r in sorted(keyword.scores(index, queries).collect(), key=lambda r: -r.score):
        best.setdefault(r.query_id, []).append(r.score)
    assert len(whole) >= 10 and all(r.score == best[r.query_id][r.rank - 1] for r in whole)


def test_a_text_moves_once_for_a_block_of_queries(rows, monkeypatch):
    """What is chosen from gets each candidate's text once, however many queries have it, and blocks choose as pairs do."""
    chunks = rows([(f"c{i}", "p", "d1", i, f"harbour crane {w} {w}{w} pier{i} boat{i} rope{i}", i + 5, "markdown") for i, w in enumerate(["red", "blue", "green", "grey"])] * 2, SCHEMA + ", end_char int, strategy string")
    docs = rows([("d1", "T", "web", None, 2)], "id string, title string, source_type string, source_url string, confidence_level int")
    queries = rows([(f"q{i}", "p", f"harbour crane {w}") for i, w in enumerate(["red", "blue", "green", "grey", "red blue", "none"])], "query_id string, project_id string, text string")
    seen = []
    real = search.chosen_in_blocks
    monkeypatch.setattr(search, "chosen_in_blocks", lambda lists, found, *a: (seen.append((lists.count(), found.count())), real(lists, found, *a))[1])
    got = sorted(search.search(queries, chunks, docs, mode="keyword", top_k=3).collect())
    assert seen == [(6, 4)]
    assert got == sorted(search.search(queries, chunks, docs, mode="keyword", top_k=3, reranker=lambda q, t: rerank.lexical_logit(q, t)).collect())


def test_empty_index(rows):
    chunks = rows([], SCHEMA)
    assert keyword.search(keyword.build(chunks), rows([("q", "p", "a")], "query_id string, project_id string, text string")).collect() == []


def test_index_round_trip(spark, rows, tmp_path):
    index = keyword.build(rows(CHUNKS, SCHEMA))
    keyword.write_index(index, str(tmp_path), "v1")
    again = keyword.read_index(spark, str(tmp_path), "v1")
    queries = rows([("q1", "p", "apple pie")], "query_id string, project_id string, text string")
    assert sorted(keyword.scores(again, queries).collect()) == sorted(keyword.scores(index, queries).collect())


def test_stale_index(rows):
    s = "project_id string, n long, last_indexed_at string"
    now = rows([("a", 1, None), ("b", 2, "x"), ("c", 1, "x"), ("d", 1, None)], s)
    then = rows([("a", 1, None), ("b", 1, "x"), ("c", 1, None)], s)
    assert {r[0] for r in keyword.stale(now, then).collect()} == {"b", "c", "d"}


def test_semantic(rows):
    s = "chunk_id string, project_id string, model_name string, vector array<float>"
    vectors = rows([("a", "p", "m", [1.0, 0.0]), ("b", "p", "m", [0.0, 2.0]), ("c", "p", "m", [0.0, 1.0]), ("d", "q", "m", [1.0, 0.0])], s)
    asked = vectors.where("chunk_id = 'b'").withColumn("query_id", F.col("chunk_id")).drop("chunk_id")
    got = semantic.search(vectors, asked, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("b", 1.0), ("c", 1.0), ("a", 0.5)]


def test_usable_vectors(rows):
    df = rows([(None, 2), ([], 0), ([0.0, 0.0], 2), ([float("nan"), 1.0], 2), ([1.0], 2), ([1.0, None], 2), ([1.0, 2.0], 2), ([1.0, 2.0], None)], "v array<float>, n int")
    assert [r[0] for r in df.select(semantic.usable(F.col("v"), F.col("n"))).collect()] == [False] * 6 + [True, False]


def test_upsert_and_delete(rows):
    s = "id string, chunk_id string, model_name string, created_at string, vector array<float>"
    store = rows([("1", "a", "m", "2", [1.0]), ("2", "b", "m", "1", [1.0])], s)
    new = rows([("3", "a", "m", "1", [2.0]), ("4", "a", "k", "1", [3.0])], s)
    out = semantic.merged(store, new)
    assert sorted((r.id, r.vector[0]) for r in out.collect()) == [("2", 1.0), ("3", 2.0), ("4", 3.0)]
    assert sorted(r.id for r in semantic.merged(out, new).collect()) == ["2", "3", "4"]
    assert [r.id for r in semantic.without(out, new).collect()] == ["2"]


def test_fusion_ties(rows):
    s = "query_id string, chunk_id string, rank int"
    a = rows([("q", "x", 1), ("q", "y", 2)], s)
    b = rows([("q", "y", 2), ("q", "z", 1)], s)
    got = [(r.chunk_id, r.fused, r.rank) for r in fusion.fuse(a, b).orderBy("rank").collect()]
    assert got == [("y", round(2 / 62, 6), 1), ("x", round(1 / 61, 6), 2), ("z", round(1 / 61, 6), 3)]
    assert fusion.fuse(a, b, most=1).count() == 1


def test_fused_lists_move_once(rows):
    s = "query_id string, chunk_id string, rank int"
    plan = fusion.fuse(rows([("q", "x", 1)], s), rows([("q", "y", 1)], s))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_choose_every_branch():
    same = "alpha beta gamma delta"
    assert rerank.choose([0.0], ["low but best"], 10, 0.5, 1000) == [(0, "low but best")]
    assert [i for i, _ in rerank.choose([0.9, 0.4, 0.3], ["a b", "c d", "e f"], 10, 0.35, 1000)] == [0, 1]
    assert [i for i, _ in rerank.choose([0.9, 0.8, 0.7], [same, same + " epsilon", "other words"], 10, 0.1, 1000)] == [0, 2]
    assert [i for i, _ in rerank.choose([0.9, 0.8], ["x" * 900, "y" * 200], 10, 0.1, 1000)] == [0]
    assert [i for i, _ in rerank.choose([0.9, 0.8], ["one", "two"], 1, 0.1, 1000)] == [0]
    assert rerank.choose([], [], 1, 0.1, 1000) == []
    assert [i for i, _ in rerank.choose([0.9, 0.8], ["", ""], 5, 0.1, 1000)] == [0, 1]
    assert len(rerank.choose([0.9], ["z" * 2000], 5, 0.1, 1000)[0][1]) == 1503


def test_whole_search(rows):
    chunks = rows([(f"c{i}", "p", "d1", i, f"[Source: T]\nharbour crane number {w}", i + 5, "markdown") for i, w in enumerate(["one red", "two blue", "three green", "four"])] + [("o", "p", "gone", 0, "harbour crane", 1, "markdown")], SCHEMA + ", end_char int, strategy string")
    docs = rows([("d1", "T", "web", None, 2)], "id string, title string, source_type string, source_url string, confidence_level int")
    queries = rows([("q", "p", "red harbour crane"), ("none", "empty", "red")], "query_id string, project_id string, text string")
    for mode in ("keyword", "semantic", "hybrid"):
        got = search.search(queries, chunks, docs, mode=mode, top_k=3).orderBy("result_no").collect()
        assert got and {r.query_id for r in got} == {"q"} and got[0].chunk_id == "c0" and got[0].text == "harbour crane number one red"
        assert [r.result_no for r in got] == list(range(1, len(got) + 1)) and len(got) <= 3 and "o" not in {r.chunk_id for r in got}


@pytest.mark.parametrize("bad", [{"mode": "other"}, {"top_k": 0}, {"top_k": 51}, {"min_score": 1.5}, {"context_budget": 10}])
def test_parameters_are_checked(bad):
    with pytest.raises(ValueError):
        search.check(**({"mode": "hybrid", "top_k": 10, "min_score": 0.1, "budget": 10_000} | {("budget" if k == "context_budget" else k): v for k, v in bad.items()}))


def test_lists_of_a_large_project(rows, monkeypatch):
    import numpy as np

    from docloom.operators import ann

    monkeypatch.setattr(ann, "EXACT", 300)
    monkeypatch.setattr(ann, "LIST_ROWS", 60)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(25, 12))
    x = (centres[rng.integers(0, 25, 1500)] + rng.normal(scale=0.5, size=(1500, 12))).tolist()
    data = [(f"c{i:04d}", "big", "m", v) for i, v in enumerate(x)] + [(f"s{i}", "small", "m", v) for i, v in enumerate(x[:40])] + [("z", "small", "other", [1.0, 0.0])]
    vectors = rows(data, "chunk_id string, project_id string, model_name string, vector array<float>")
    queries = vectors.where("chunk_id LIKE '%7' OR chunk_id = 'z'").withColumnRenamed("chunk_id", "query_id")
    index = ann.build(vectors, 10, 0.95)
    assert index.centres.where("project_id = 'big'").count() >= 20 and index.vectors.count() == len(data)
    probes = index.centres.where("project_id = 'big'").first().probes
    assert 1 <= probes < 20
    exact = {(r.query_id, r.chunk_id): r.score for r in semantic.search(vectors, queries, 10).collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in ann.search(index, queries, 10).collect()}
    small = lambda d: {k: v for k, v in d.items() if k[0][0] in "sz"}
    assert small(got) == small(exact) and len(small(got)) > 30
    big = {k for k in exact if k[0][0] == "c"}
    assert len(big & set(got)) / len(big) >= 0.9
    assert ann.search(ann.build(vectors.limit(0)), queries, 10).count() == 0
