"""Problem 2: oversized chunks cut at natural boundaries, with an overlap.

A recursive hierarchy of separators: section, paragraph, sentence or line, word, and at
last the token itself. Atoms are packed greedily up to the limit; an atom that would fit
whole into a fresh piece is never broken, a larger one is entered at the next level.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The token of problem 2; fixed by its statement.
TOKEN = r"[\p{L}\p{N}_]{1,6}"
LIMIT, OVERLAP = 500, 50

_TOKEN = regex.compile(TOKEN)
#: A match's end is a boundary, by level; each level also has those of the levels before.
_LEVELS = (
    regex.compile(r"\n(?=[ \t]{0,3}(?:#{1,6}[ \t]|\[Section: |={3,}[ \t]*$|-{3,}[ \t]*$))", regex.M),
    regex.compile(r"\n[ \t\r]*\n\s*"),
    regex.compile(r"(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=[。！？])|\n\s*"),
    regex.compile(r"\s+"),
)


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece of ``text``, code points, half-open.

    Consecutive pieces share exactly ``overlap`` tokens; every token is in some piece.
    A text within the limit comes back whole; one without tokens gives one piece of 0.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    starts, ends = [], []
    for m in _TOKEN.finditer(text):
        starts.append(m.start())
        ends.append(m.end())
    n = len(starts)
    if n <= limit:
        return [(0, len(text), n)]
    # A boundary is kept as the number of tokens before it, with its place in the text.
    levels: list[list[int]] = []
    place: dict[int, int] = {n: len(text)}
    for pattern in _LEVELS:
        for m in pattern.finditer(text):
            place.setdefault(bisect_left(starts, m.end()), m.end())
        levels.append(sorted(place))
    room = limit - overlap
    out, first, done = [], 0, 0
    while True:
        most, end = min(first + limit, n), done
        for bounds in levels:
            k = bisect_right(bounds, most) - 1
            end = max(end, bounds[k] if k >= 0 else 0)
            following = bounds[bisect_right(bounds, end)] if end < n else n
            if end > max(done, overlap) and following - end <= room:
                break
        else:
            end = end if end > max(done, overlap) else most
        a = 0 if not first else place.get(first, starts[first]) if first == done else starts[first]
        b = place[end] if end in place else ends[end - 1]
        piece = text[a:b]
        b -= 0 if end == n else len(piece) - len(piece.rstrip())
        out.append((a, b, end - first))
        if end == n:
            return out
        done, first = end, max(end - overlap, 0)


def split_oversized(
    df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, keep: tuple[str, ...] = ("id",)
) -> DataFrame:
    """The pieces of the rows whose ``text`` has more than ``limit`` tokens.

    Columns: ``keep``, ``piece_no`` from 1, ``piece``, ``start``, ``end`` (in ``text``, code
    points, half-open) and ``tokens``. Null, empty and small texts give no rows; rows
    repeated in the input are repeated in the output; other columns are left out. The
    count is made in the JVM, so only oversized texts travel to Python, each one whole.
    """
    big = df.where(F.regexp_count(F.col(text), F.lit(TOKEN)) > limit).select(*keep, F.col(text).alias("__text"))
    schema = big.drop("__text").schema.simpleString()[7:-1]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, at = [], []
            for i, t in enumerate(pdf["__text"]):
                for no, (a, b, n) in enumerate(cut(t, limit, overlap), 1):
                    rows.append((no, t[a:b], a, b, n))
                    at.append(i)
            got = pd.DataFrame(rows, columns=["piece_no", "piece", "start", "end", "tokens"])
            yield pd.concat([pdf.drop(columns="__text").iloc[at].reset_index(drop=True), got], axis=1)

    return big.mapInPandas(pieces, f"{schema}, piece_no int, piece string, start int, end int, tokens int")


_PREFIX = r"^(?:\[(?:Source|Section): [^\n]*\]\n+)*"


def place_in_documents(pieces: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``start_char`` and ``end_char`` of pieces in their document's ``raw_text``.

    The offsets stored with a chunk aren't trusted: the chunk's text after its leading
    source and section lines is looked up in ``raw_text``, first where the chunk says it
    begins, else at its first occurrence. Both are null where it doesn't occur, where the
    document is missing or where the piece lies in the leading lines.
    """
    body = (
        chunks.dropDuplicates(["id"])
        .join(pieces.select("id").distinct(), "id", "left_semi")
        .select("id", "doc_id", "start_char", F.regexp_replace("text", _PREFIX, "").alias("body"), F.length("text").alias("whole"))
    )
    raw = documents.dropDuplicates(["id"]).select(F.col("id").alias("doc_id"), "raw_text")
    told = F.col("start_char") >= 0
    at = F.when(told & F.expr("substring(raw_text, start_char + 1, length(body)) = body"), F.col("start_char")).otherwise(
        F.expr("nullif(locate(body, raw_text), 0) - 1")
    )
    base = body.join(raw, "doc_id", "left").select(
        "id", "doc_id", F.when(F.length("body") > 0, at).alias("at"), (F.col("whole") - F.length("body")).alias("lead")
    )
    shift = F.col("at") - F.col("lead")
    return (
        pieces.join(base, "id", "left")
        .withColumn("start_char", F.when(F.col("end") > F.col("lead"), F.greatest(F.col("start"), F.col("lead")) + shift).cast("int"))
        .withColumn("end_char", F.when(F.col("end") > F.col("lead"), F.col("end") + shift).cast("int"))
        .drop("at", "lead")
    )


def rules(pieces: DataFrame, texts: DataFrame, text: str = "text", overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """(id, within_limit, overlapping, in_order, whole): what holds for the ``pieces`` of each of ``texts`` (id, text) that was cut.

    Whether no piece passes the limit, each shares ``overlap`` tokens with the one before and
    ends behind it, and the pieces together have every token of the text.
    """
    one = Window.partitionBy("id").orderBy("piece_no")
    rows = pieces.join(texts.select("id", F.col(text).alias("__text")), "id").withColumn("__end", F.lag("end").over(one)).withColumn("__start", F.lag("start").over(one))
    shared = F.regexp_count(F.substring(F.col("__text"), F.col("start") + 1, F.greatest(F.col("__end") - F.col("start"), F.lit(0))), F.lit(TOKEN))
    later = F.col("__end").isNull()
    return rows.groupBy("id").agg(
        F.bool_and(F.col("tokens") <= limit).alias("within_limit"),
        F.bool_and(later | (shared == overlap)).alias("overlapping"),
        F.bool_and(later | ((F.col("start") > F.col("__start")) & (F.col("end") > F.col("__end")))).alias("in_order"),
        (F.sum("tokens") - overlap * (F.count(F.lit(1)) - 1) == F.regexp_count(F.first("__text"), F.lit(TOKEN))).alias("whole"),
    )
