"""Vectors of texts: providers by name, and recomputing only what changed."""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(ABC):
    """A provider of vectors. Objects are sent to the workers and keep no state beyond a batch."""

    name: str
    dimension: int

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""

    def embed_one(self, text: str) -> list[float]:
        """The vector of one text."""
        return self.embed([text])[0]

    def column(self, text: Column | str) -> Column:
        """The vector of a text column, batch by batch; null stays null."""
        embed = self.embed

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            got = iter(embed([t for t in texts if t is not None]))
            return pd.Series([None if t is None else next(got) for t in texts], dtype=object)

        return vectors(text)


_WORD = regex.compile(r"[\p{L}\p{N}_]+")


class HashedWords(Embedder):
    """Signed feature hashing of words, damped by their number, of unit length.

    It stands in for a sentence model, which needs trained weights: same interface and
    length, other similarities. A text without words has the zero vector.
    """

    def __init__(self, dimension: int = 384, name: str = "hashed-words-384") -> None:
        self.dimension, self.name = dimension, name

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            counts: dict[str, int] = {}
            for w in _WORD.findall(text.lower()):
                counts[w] = counts.get(w, 0) + 1
            for w, n in counts.items():
                h = xxhash.xxh3_64_intdigest(w.encode())
                row[(h >> 1) % self.dimension] += (1 if h & 1 else -1) * (1 + math.log(n))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(length > 0, length, 1)).astype(np.float32).tolist()


_PROVIDERS: dict[str, Callable[[], Embedder]] = {"hashed-words-384": HashedWords}


def register(name: str, make: Callable[[], Embedder]) -> None:
    """Adds a provider under a name."""
    _PROVIDERS[name] = make


def provider(name: str) -> Embedder:
    """The provider of a name; an unknown one is a KeyError that names the known ones."""
    if name not in _PROVIDERS:
        raise KeyError(f"no embedder {name!r}; there are {', '.join(sorted(_PROVIDERS))}")
    return _PROVIDERS[name]()


def plan(chunks: DataFrame, store: DataFrame, model: str) -> DataFrame:
    """(chunk_id, content_hash, is_cached): which chunks (id, text) have a vector of ``model`` for their present text.

    One left join on the chunk; only hashes are shuffled. Of several stored rows the latest counts.
    """
    now = chunks.where("text IS NOT NULL").dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))
    held = store.where(F.col("model_name") == model).groupBy("chunk_id").agg(F.max_by("content_hash", F.struct("created_at", "id")).alias("held"))
    return now.join(held, "chunk_id", "left").select("chunk_id", "content_hash", F.coalesce(F.col("held") == F.col("content_hash"), F.lit(False)).alias("is_cached"))


def embed_changed(chunks: DataFrame, store: DataFrame, embedder: Embedder, now: Column) -> DataFrame:
    """The rows of ``store`` for ``chunks`` and ``embedder``, each with ``is_cached``; only changed texts are embedded."""
    todo = plan(chunks, store, embedder.name)
    mine = store.where(F.col("model_name") == embedder.name)
    rest = [c for c in store.columns if c != "chunk_id"]
    held = mine.groupBy("chunk_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("v")).select("chunk_id", "v.*")
    cached = held.join(todo.where("is_cached").select("chunk_id"), "chunk_id", "left_semi").withColumn("is_cached", F.lit(True))
    text = chunks.dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), "text")
    fresh = todo.where("NOT is_cached").join(text, "chunk_id").select(
        F.substring(F.sha2(F.concat_ws("/", "chunk_id", F.lit(embedder.name)), 256), 1, 12).alias("id"),
        "chunk_id",
        F.lit(embedder.name).alias("model_name"),
        F.lit(embedder.dimension).alias("dimension"),
        "content_hash",
        embedder.column("text").alias("vector"),
        now.alias("created_at"),
        F.lit(False).alias("is_cached"),
    )
    return cached.select(*fresh.columns).unionByName(fresh)


def of_documents(embeddings: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """The embeddings of the chunks of ``docs`` (id)."""
    mine = chunks.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    return embeddings.join(mine, "chunk_id", "left_semi").select(*embeddings.columns)
