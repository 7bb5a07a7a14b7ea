"""Second-stage scores and the adaptive choice among candidates."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scores import sigmoid
from ..functions.text import key_words, tokens

#: What a result's text is cut to, and the overlap with an earlier one above which it is left out.
MAX_CHARS, SAME_TEXT = 1_500, 0.70


def lexical_logit(query: Column, text: Column) -> Column:
    """The default reranker's logit: how many of the query's key words the text has, from -3 to 3.

    It stands in for a cross-encoder, which needs a trained model: same interface, other
    scores. A query without key words is scored on all its words.
    """
    return coverage_logit(asked_words(query), tokens(text))


def asked_words(query: Column) -> Column:
    """The different words that a query is scored on."""
    return F.array_distinct(F.when(F.size(key_words(query)) > 0, key_words(query)).otherwise(tokens(query)))


def coverage_logit(asked: Column, words: Column) -> Column:
    """The logit from word arrays; with them a text is taken apart once, not once per query."""
    has = F.size(F.array_intersect(asked, words))
    return 6.0 * F.coalesce(F.try_divide(has, F.size(asked)), F.lit(0.0)) - 3.0


Reranker = Callable[[Column, Column], Column]


def model_reranker(load: Callable[[], Callable[[list[str], list[str]], list[float]]]) -> Reranker:
    """A reranker from a model: ``load`` is called once per Python worker and gives a function from queries and texts to logits."""

    @F.pandas_udf("double")
    def logit(queries: pd.Series, texts: pd.Series) -> pd.Series:
        global _MODEL
        if "_MODEL" not in globals() or _MODEL[0] is not load:
            _MODEL = (load, load())
        return pd.Series(_MODEL[1](queries.fillna("").to_list(), texts.fillna("").to_list()), dtype="float64")

    return logit


def rerank(candidates: DataFrame, reranker: Reranker = lexical_logit, k: int | None = None) -> DataFrame:
    """``candidates`` (query_id, query, chunk_id, text, rank, ...) with ``rerank_score`` and their new ``rank``.

    With the default reranker and columns ``asked`` and ``words`` texts aren't taken apart again.
    The score is the logistic of the logit, rounded to six places. Ties keep the order of
    the first stage. ``k`` cuts the list.
    """
    apart = reranker is lexical_logit and {"asked", "words"} <= set(candidates.columns)
    logit = coverage_logit(F.col("asked"), F.col("words")) if apart else reranker(F.col("query"), F.col("text"))
    scored = candidates.withColumn("rerank_score", F.round(sigmoid(logit), 6)).drop(*(("asked", "words") if apart else ()))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "chunk_id")
    out = scored.withColumn("__new", F.row_number().over(best)).drop("rank").withColumnRenamed("__new", "rank")
    return out.where(F.col("rank") <= k) if k else out


_SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
_WORD = re.compile(r"\w+")


def shortened(text: str, limit: int = MAX_CHARS) -> str:
    """Text above the limit cut after its last full stop in the second half, else cut and dotted."""
    if len(text) <= limit:
        return text
    stop = text.rfind(".", 0, limit)
    return text[: stop + 1] if stop > limit // 2 else text[:limit] + "..."


def _prepared(text: str | None) -> tuple[str, set[str]]:
    """A text as it is shown, and its different words."""
    clean = shortened((text or "").strip(_SPACE))
    return clean, set(_WORD.findall(clean.lower()))


def choose(scores: Iterable[float], texts: Iterable, top_k: int, min_score: float, budget: int, prepare: Callable[..., tuple[str, set[str]]] = _prepared) -> list[tuple[int, str]]:
    """(position, shortened text) of the candidates that are kept, given best first.

    The list ends at the first score below the floor once something was kept, at ``top_k``,
    and where the budget of characters would be passed; a text that mostly repeats a kept
    one is skipped. The best candidate is always kept. ``prepare`` makes what is shown and
    compared of an item of ``texts``.
    """
    kept: list[tuple[int, str]] = []
    seen: list[set[str]] = []
    used = 0
    for i, (score, text) in enumerate(zip(scores, texts)):
        if kept and (score < min_score or len(kept) >= top_k):
            break
        clean, words = prepare(text)
        if any(words and s and len(words & s) > SAME_TEXT * min(len(words), len(s)) for s in seen):
            continue
        seen.append(words)
        if kept and used + len(clean) > budget:
            break
        used += len(clean)
        kept.append((i, clean))
    return kept


def select_adaptively(reranked: DataFrame, top_k: int = 10, min_score: float = 0.01, budget: int = 10_000) -> DataFrame:
    """The results of each query, in order: ``reranked`` cut by :func:`choose`, with ``result_no`` and the shortened ``text``.

    Candidates are bounded (at most six times ``top_k`` a query), so the fold runs over one
    row per query. Per-query columns ``top_k``, ``min_score`` and ``context_budget`` win
    over the parameters.
    """
    given = lambda c, v: F.first(F.col(c)) if c in reranked.columns else F.lit(v)
    # What is below the floor ends the list, unless it is the best: it need not be gathered.
    floor = F.col("min_score") if "min_score" in reranked.columns else F.lit(min_score)
    reranked = reranked.where((F.col("rank") == 1) | (F.col("rerank_score") >= floor))
    rest = [c for c in reranked.columns if c not in ("text", "top_k", "min_score", "context_budget", "rank")]
    item = F.struct("rank", "text", F.struct(*rest).alias("row"))
    rows = reranked.groupBy("query_id").agg(
        F.array_sort(F.collect_list(item), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).otherwise(0)).alias("items"),
        given("top_k", top_k).alias("k"),
        given("min_score", min_score).alias("floor"),
        given("context_budget", budget).alias("room"),
    )

    @F.pandas_udf("array<struct<position int, text string>>")
    def kept(scores: pd.Series, texts: pd.Series, ks: pd.Series, floors: pd.Series, rooms: pd.Series) -> pd.Series:
        return pd.Series([[{"position": i, "text": t} for i, t in choose(list(s), list(x), int(k), float(f), int(r))] for s, x, k, f, r in zip(scores, texts, ks, floors, rooms)])

    chosen = kept(F.transform("items", lambda i: i["row"]["rerank_score"]), F.transform("items", lambda i: i["text"]), "k", "floor", "room")
    out = rows.withColumn("chosen", chosen).select("items", F.posexplode("chosen").alias("n", "one"))
    row = F.get("items", F.col("one.position"))["row"]
    return out.select((F.col("n") + 1).alias("result_no"), F.col("one.text").alias("text"), row.alias("row")).select("result_no", "text", "row.*")


def _covered(asked: pa.ChunkedArray, words: pa.ChunkedArray, query: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """The scores of pairs of a query and a chunk, of lists of different words: what :func:`coverage_logit` gives through :func:`sigmoid`, rounded."""
    n_asked, n_words = pc.list_value_length(asked).to_numpy(), pc.list_value_length(words).to_numpy()
    coded = pc.list_flatten(asked).combine_chunks().dictionary_encode()
    code, most = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
    known = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=coded.dictionary), -1).to_numpy()
    held = np.sort((np.repeat(np.arange(len(n_words)), n_words) * most + known)[known >= 0])
    size = n_asked[query]
    pair = np.repeat(np.arange(len(query)), size)
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    key = chunk[pair] * most + code[(np.cumsum(n_asked) - n_asked)[query][pair] + nth]
    at = np.searchsorted(held, key)
    hit = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == key) if len(held) else np.zeros(len(key), bool)
    share = np.bincount(pair, hit, len(query)) / np.maximum(size, 1)
    return np.round(1 / (1 + np.exp(3.0 - 6.0 * share)), 6)


def chosen_in_blocks(lists: DataFrame, found: DataFrame, keys: list[str], top_k: int, min_score: float, budget: int) -> DataFrame:
    """The results of the default reranker and :func:`choose`: for each query of ``lists`` (query_id, chunk_ids in order, asked) those of its candidates that are in its block of ``found`` (chunk_id, text, words, ...).

    Blocks are rows with the same ``keys``. Gives query_id, result_no, rerank_score, the
    shortened text and the other columns of ``found``.
    """
    rest = [c for c in found.columns if c not in (*keys, "text", "words")]
    schema = T.StructType([lists.schema["query_id"], T.StructField("result_no", T.IntegerType()), T.StructField("rerank_score", T.DoubleType()), T.StructField("text", T.StringType()), *(found.schema[c] for c in rest)])

    lists, found = lists.toDF(*lists.columns), found.toDF(*found.columns)
    empty = to_arrow_schema(schema).empty_table()

    def chosen(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return empty
        found = found.combine_chunks()
        texts, n = found.column("text"), pc.list_value_length(asked.column("chunk_ids")).to_numpy()
        at = pc.fill_null(pc.index_in(pc.list_flatten(asked.column("chunk_ids")), value_set=found.column("chunk_id").chunk(0)), -1).to_numpy()
        query, chunk = np.repeat(np.arange(len(n)), n)[at >= 0], at[at >= 0]
        score = _covered(asked.column("asked"), found.column("words"), query, chunk)
        # Ties keep the order of the lists.
        order = np.lexsort((np.arange(len(query)), -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        prepare = lru_cache(maxsize=None)(lambda i: _prepared(texts[i].as_py()))
        ends = np.searchsorted(query, np.arange(len(n) + 1))
        kept = []
        for a, b in zip(ends, ends[1:]):
            kept += [(no, a + i, text) for no, (i, text) in enumerate(choose(score[a:b].tolist(), chunk[a:b].tolist(), top_k, min_score, budget, prepare), 1)]
        at = np.array([i for _, i, _ in kept], int)
        of = found.select(rest).take(pa.array(chunk[at]))
        first = [asked.column("query_id").take(pa.array(query[at])), pa.array([no for no, _, _ in kept], pa.int32()), pa.array(score[at]), pa.array([text for _, _, text in kept], pa.string())]
        return pa.table([*first, *of.columns], names=schema.names)

    return lists.groupBy(*keys).cogroup(found.groupBy(*keys)).applyInArrow(chosen, schema)
