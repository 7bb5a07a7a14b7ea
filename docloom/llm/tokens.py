"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; a parameter of everything that counts tokens.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern of that vocabulary; fixed by its publisher.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    """The tokenizer of a rank file's content; made once per process."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_tokens(df: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text``, with ``tokens``: the tokens of the whole text, 0 for null and empty ones.

    A column ``tokens`` that was there is replaced. The driver reads the vocabulary and sends it along, under 1 MB.
    """
    with open(vocabulary, "rb") as f:
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    rest = df.drop(text, "tokens")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(sent.value)
        for pdf in batches:
            n = [len(own.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield pdf.drop(columns=text).assign(tokens=n)

    return df.select(*rest.columns, F.col(text)).mapInPandas(counted, f"{schema}, tokens long")
