"""The whole search: candidates of one or two lists, second-stage scores, adaptive choice."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_context_prefix, tokens
from ..operators import ann, fusion, keyword, semantic
from ..operators.embedding import Embedder, HashedWords
from ..operators.rerank import Reranker, asked_words, chosen_in_blocks, lexical_logit, rerank, select_adaptively
from ..session import cut_lineage, once, sent

#: Candidates per result that is asked for.
OVERFETCH = 6
#: Queries whose candidates' texts a task holds at a time.
BLOCK = 2_048


class Mode(str, Enum):
    """How candidates are found."""

    KEYWORD = "keyword"
    SEMANTIC = "semantic"
    HYBRID = "hybrid"


def check(mode: str, top_k: int, min_score: float, budget: int) -> Mode:
    """The mode, if all parameters are within their domains; else a ValueError."""
    if not 1 <= top_k <= 50:
        raise ValueError("top_k must be from 1 to 50")
    if not 0 <= min_score <= 1:
        raise ValueError("min_score must be from 0 to 1")
    if not 1_000 <= budget <= 50_000:
        raise ValueError("context_budget must be from 1000 to 50000")
    return Mode(mode)


def candidates(queries: DataFrame, chunks: DataFrame, mode: Mode, k: int, index: keyword.Index | None = None, vectors: DataFrame | ann.Index | None = None, embedder: Embedder | None = None) -> DataFrame:
    """(query_id, chunk_id, rank): the ``k`` best chunks of each query in the mode's own order.

    ``vectors`` are those that are stored, searched exactly, or an approximate index of
    them; without any the chunks are embedded here.
    """
    lists = []
    if mode in (Mode.SEMANTIC, Mode.HYBRID):
        embedder = embedder or HashedWords()
        if vectors is None:
            text = chunks.dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), "project_id", F.lit(embedder.name).alias("model_name"), embedder.column(F.coalesce("text", F.lit(""))).alias("vector"))
            vectors = text.where(semantic.usable(F.col("vector")))
        asked = queries.select("query_id", "project_id", F.lit(embedder.name).alias("model_name"), embedder.column("text").alias("vector"))
        asked = asked.where(semantic.usable(F.col("vector")))
        lists.append(ann.search(vectors, asked, k) if isinstance(vectors, ann.Index) else semantic.search(vectors, asked, k))
    if mode in (Mode.KEYWORD, Mode.HYBRID):
        lists.append(keyword.search(index or keyword.build(chunks), queries, k))
    if len(lists) == 1:
        return lists[0].select("query_id", "chunk_id", "rank")
    return fusion.fuse(*lists, most=k).select("query_id", "chunk_id", "rank")


def search(
    queries: DataFrame,
    chunks: DataFrame,
    docs: DataFrame,
    mode: str = "hybrid",
    top_k: int = 10,
    min_score: float = 0.01,
    context_budget: int = 10_000,
    reranker: Reranker = lexical_logit,
    **stage1,
) -> DataFrame:
    """The results of ``queries`` (query_id, project_id, text) over the chunks of their projects.

    (query_id, result_no, chunk_id, doc_id, text, score, start_char, end_char, strategy,
    doc_title, source_type, source_url, confidence_level). Only chunks of existing
    documents count, and they do before the candidates are cut. A query of an empty project
    has no results.
    """
    mode_ = check(mode, top_k, min_score, context_budget)
    queries = cut_lineage(queries.select("query_id", "project_id", "text"))  # read by every list, and for the choice
    about = docs.select(F.col("id").alias("doc_id"), F.col("title").alias("doc_title"), "source_type", "source_url", "confidence_level")
    live = chunks.join(about.select("doc_id"), "doc_id", "left_semi")
    ranked = candidates(queries, live, mode_, OVERFETCH * top_k, **stage1)
    shown = strip_context_prefix("text").alias("text")
    if reranker is lexical_logit:
        chosen = _chosen(queries, ranked, chunks, about, shown, top_k, min_score, context_budget)
    else:
        texts = live.dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), "doc_id", shown, "start_char", "end_char", "strategy")
        pairs = ranked.join(queries.select("query_id", F.col("text").alias("query")), "query_id").join(texts, "chunk_id").join(about, "doc_id")
        chosen = select_adaptively(rerank(pairs, reranker), top_k, min_score, context_budget)
    return chosen.select(
        "query_id", "result_no", "chunk_id", "doc_id", "text", F.col("rerank_score").alias("score"), "start_char", "end_char", "strategy", "doc_title", "source_type", "source_url", "confidence_level"
    )


def _chosen(queries: DataFrame, ranked: DataFrame, chunks: DataFrame, about: DataFrame, shown: Column, top_k: int, min_score: float, budget: int) -> DataFrame:
    """The results by the default reranker, of queries in blocks of a project.

    A block gets each text that is a candidate of any of its queries once, not once for each
    pair, and what moves with a query is the list of its candidates' ids.
    """
    blocks = sent(queries.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")))
    asked = queries.dropDuplicates(["query_id"]).join(blocks, "project_id").select("query_id", "project_id", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), asked_words(F.col("text")).alias("asked"))
    best_first = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda c: c["chunk_id"])
    keys, parts = ["project_id", "block"], int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = ranked.groupBy("query_id").agg(best_first.alias("chunk_ids")).join(asked, "query_id")
    # Read twice below, for the texts that a block needs and for the choice, and both times by blocks.
    lists = cut_lineage(lists.repartition(parts, *keys))
    needed = lists.select(*keys, F.explode("chunk_ids").alias("chunk_id")).distinct()
    places = chunks.select(F.col("id").alias("chunk_id"), "doc_id").join(about, "doc_id").dropDuplicates(["chunk_id"])
    texts = once(chunks.select("id", "text", "start_char", "end_char", "strategy")).select(F.col("id").alias("chunk_id"), shown, "start_char", "end_char", "strategy")
    found = needed.join(places, "chunk_id").join(texts, "chunk_id").repartition(parts, *keys)
    return chosen_in_blocks(lists, found.withColumn("words", F.array_distinct(tokens("text"))), keys, top_k, min_score, budget)
