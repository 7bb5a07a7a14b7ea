"""Documents cut into chunks: by headings and size, or by size alone.

The splitter tries blank lines, line ends, blanks and characters in this order; pieces
above the limit are entered at the next separator, smaller ones are packed greedily, and
a chunk begins with the tail of the one before up to the overlap. A separator stays at
the start of the piece after it and chunks are stripped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 500, 50
#: Chunks of fewer words are dropped by the Markdown chunker.
MIN_WORDS = 15
SEPARATORS = ("\n\n", "\n", " ", "")

Counter = Callable[[str], int]
_PIECE = regex.compile(r"[\p{L}\p{N}_]{1,6}|[^\s\p{L}\p{N}_]")


def approximate_tokens(text: str) -> int:
    """Words in pieces of six characters and single marks: close to byte-pair counts without a vocabulary."""
    return sum(1 for _ in _PIECE.finditer(text))


@lru_cache(maxsize=2)
def _encoder(ranks: bytes, pattern: str):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


class VocabularyCounter:
    """A counter by a byte-pair vocabulary in a rank file, read once here and sent along with the tasks.

    ``pattern`` splits the text before pairs are merged, as the vocabulary's publisher gives
    it. Needs the optional package tiktoken.
    """

    def __init__(self, path: str, pattern: str = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+") -> None:
        with open(path, "rb") as f:
            self.ranks = f.read()
        self.pattern = pattern

    def __call__(self, text: str) -> int:
        return len(_encoder(self.ranks, self.pattern).encode_ordinary(text))


def _packed(parts: list[str], count: Counter, limit: int, overlap: int) -> Iterator[str]:
    """Parts merged up to the limit, each chunk beginning with the last parts of the one before."""
    sizes = [count(p) for p in parts]
    held: list[int] = []
    total = 0
    for i, size in enumerate(sizes):
        if held and total + size > limit:
            yield "".join(parts[j] for j in held)
            while held and (total > overlap or total + size > limit):
                total -= sizes[held.pop(0)]
        held.append(i)
        total += size
    if held:
        yield "".join(parts[j] for j in held)


def split_text(text: str, count: Counter = approximate_tokens, limit: int = LIMIT, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """The stripped chunks of a text, none of them empty; each within the limit by ``count``."""
    separator = next((s for s in separators if s and s in text), "")
    finer = separators[separators.index(separator) + 1 :] if separator in separators else ()
    parts = list(text) if not separator else [p for p in re.split(f"(?={re.escape(separator)})", text) if p]
    out: list[str] = []
    small: list[str] = []
    for part in parts:
        if count(part) <= limit:
            small.append(part)
            continue
        out += _packed(small, count, limit, overlap)
        small = []
        out += split_text(part, count, limit, overlap, finer) if finer else [part]
    out += _packed(small, count, limit, overlap)
    return [s for s in (x.strip() for x in out) if s]


_TABLE = re.compile(r"(?:^[ \t]*\|.*\|[ \t]*(?:\n|\Z)){2,}", re.M)
_HEADING = re.compile(r"^(#{1,3})\s+(.*?)\s*$")
_FENCE = re.compile(r"^\s*(```|~~~)")


def sections(text: str) -> list[tuple[tuple[str, ...], str]]:
    """(headings of levels 1 to 3, body) of Markdown; heading lines leave the body, fenced code is not looked into."""
    out: list[tuple[tuple[str, ...], str]] = []
    path: dict[int, str] = {}
    lines: list[str] = []
    fence = ""

    def close() -> None:
        body = "\n".join(lines).strip()
        if body:
            out.append((tuple(path[k] for k in sorted(path)), body))
        lines.clear()

    for line in text.split("\n"):
        mark = _FENCE.match(line)
        if mark and (not fence or mark[1] == fence):
            fence = "" if fence else mark[1]
        head = None if fence or mark else _HEADING.match(line)
        if head:
            close()
            level = len(head[1])
            path = {k: v for k, v in path.items() if k < level} | {level: head[2]}
        else:
            lines.append(line)
    close()
    return out


Chunk = tuple[str, int, int, int, str, str]


def chunk_markdown(text: str, title: str = "", count: Counter = approximate_tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Chunk]:
    """(text, start, end, tokens, strategy, breadcrumbs) of a Markdown document.

    Tables are taken out before the text is split and put back whole, so a chunk that
    holds a large one may pass the limit. Offsets come from looking up the chunk's first
    line behind the previous chunk, then from the beginning; 0 and 0 if it isn't found.
    """
    tables: list[str] = []

    def keep(m: re.Match[str]) -> str:
        tables.append(m.group().rstrip("\n"))
        return f"\x02{len(tables) - 1}\x03" + "\n" * (len(m.group()) - len(m.group().rstrip("\n")))

    source = text.replace("\r\n", "\n")
    out: list[Chunk] = []
    at = 0
    for path, body in sections(_TABLE.sub(keep, source)):
        for piece in split_text(body, count, limit, overlap):
            piece = re.sub("\x02(\\d+)\x03", lambda m: tables[int(m[1])], piece)
            if len(piece.split()) < MIN_WORDS:
                continue
            crumbs = " > ".join(path) or "Root"
            full = (f"[Source: {title}]\n" if title else "") + f"[Section: {crumbs}]\n{piece}"
            anchor = next(x.strip() for x in piece.split("\n") if x.strip())[:80]
            start = source.find(anchor, at)
            start = source.find(anchor) if start < 0 else start
            end = start + len(piece) if start >= 0 else 0
            at = end if start >= 0 else at
            out.append((full, max(0, start), end, count(full), "markdown", crumbs))
    return out


def chunk_recursive(text: str, title: str = "", count: Counter = approximate_tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> list[Chunk]:
    """(text, start, end, tokens, strategy, title) of a plain text; offsets are of the first occurrence of its first 100 characters."""
    out: list[Chunk] = []
    for piece in split_text(text, count, limit, overlap):
        start = text.find(piece[:100])
        full = f"[Source: {title}]\n{piece}" if title else piece
        out.append((full, max(0, start), max(0, start + len(piece)) if start >= 0 else 0, count(full), "recursive", title))
    return out


def strategy_for(kind: Column) -> Column:
    """Plain text is cut by size, everything else by headings."""
    return F.when(F.lower(F.trim(kind)) == "text", "recursive").otherwise("markdown")


STRATEGIES = {"markdown": chunk_markdown, "recursive": chunk_recursive}
_DDL = "id string, doc_id string, project_id string, text string, start_char int, end_char int, token_count int, strategy string, metadata map<string,string>"


def chunk_documents(docs: DataFrame, counter: Counter = approximate_tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of ``docs`` (id, project_id, source_type, title, summary, raw_text).

    A document's title, with its summary if it has one, goes before each chunk. Ids are a
    hash of document, position and text, so chunking again gives the same ids. Null, empty
    and blank texts have no chunks. Documents are not shuffled.
    """
    told = F.col("summary").isNotNull() & (F.col("summary") != "") & (F.col("summary") != "No summary available.")
    title = F.concat(F.coalesce("title", F.lit("")), F.when(told, F.concat(F.lit(" - "), F.col("summary"))).otherwise(""))
    rows = docs.where("raw_text IS NOT NULL").select("id", "project_id", strategy_for(F.coalesce("source_type", F.lit(""))).alias("strategy"), title.alias("title"), "raw_text")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, project, strategy, title, text in pdf.itertuples(index=False):
                name = "breadcrumbs" if strategy == "markdown" else "doc_title"
                for n, (full, start, end, size, kind, extra) in enumerate(STRATEGIES[strategy](text, title, counter, limit, overlap)):
                    key = hashlib.sha256(f"{doc}\x00{n}\x00{full}".encode("utf-8", "surrogatepass")).hexdigest()[:12]
                    out.append((key, doc, project, full, start, end, size, kind, {name: extra} if extra else {}))
            yield pd.DataFrame(out, columns=["id", "doc_id", "project_id", "text", "start_char", "end_char", "token_count", "strategy", "metadata"])

    return rows.mapInPandas(cut, _DDL)


def rechunked(chunks: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """``chunks`` with those of ``docs`` made anew; no chunk of an earlier run stays."""
    new = chunk_documents(docs, **options).withColumn("created_at", F.lit(None).cast("timestamp"))
    kept = chunks.join(docs.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


def places(chunks: DataFrame, docs: DataFrame, tail: int = 60) -> DataFrame:
    """(id, doc_id, place): where the last ``tail`` characters of each chunk (id, doc_id, text) are in its document's ``raw_text``, from 1; 0 where they aren't.

    Chunks of no document, and null texts, have no row; an empty chunk is nowhere.
    """
    end = F.when(F.length("text") > 0, F.right(F.col("text"), F.lit(tail)))
    rows = chunks.where("text IS NOT NULL").select("id", "doc_id", end.alias("__end"))
    texts = docs.where("raw_text IS NOT NULL").select(F.col("id").alias("doc_id"), "raw_text")
    return rows.join(texts, "doc_id").select("id", "doc_id", F.coalesce(F.expr("locate(__end, raw_text)"), F.lit(0)).alias("place"))


def rules(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """What holds for the chunks that each of ``docs`` would be cut into, a row per document with a text.

    (doc_id, strategy, header, headed, within_limit, placed, long_enough, distinct_ids,
    has_chunks). ``header`` is the line that each chunk must begin with; the others say
    whether all chunks do, keep to the limit (but for tables in Markdown), lie where their
    offsets say, have enough words (Markdown), and have ids of their own. ``has_chunks`` is
    told for plain text only, as short sections of Markdown are dropped.
    """
    told = F.col("summary").isNotNull() & (F.col("summary") != "") & (F.col("summary") != "No summary available.")
    title = F.concat(F.coalesce("title", F.lit("")), F.when(told, F.concat(F.lit(" - "), F.col("summary"))).otherwise(""))
    rows = docs.where("raw_text IS NOT NULL").select(F.col("id").alias("doc_id"), strategy_for(F.coalesce("source_type", F.lit(""))).alias("strategy"), F.when(F.length(title) > 0, F.concat(F.lit("[Source: "), title, F.lit("]"))).otherwise("").alias("header"), "raw_text")
    chunks = chunk_documents(docs, limit=limit, overlap=overlap).groupBy("doc_id").agg(F.collect_list(F.struct("id", "text", "start_char", "end_char", "token_count", "metadata")).alias("chunks"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, strategy, header, text, chunks in pdf[["doc_id", "strategy", "header", "raw_text", "chunks"]].itertuples(index=False):
                source = text.replace("\r\n", "\n") if strategy == "markdown" else text
                ok = dict.fromkeys(("headed", "within_limit", "placed", "long_enough"), True)
                chunks = list(chunks) if chunks is not None else []
                for c in chunks:
                    body = c["text"]
                    ok["headed"] &= body.startswith(header + "\n") if header else True
                    body = body[len(header) + 1 :] if header else body
                    if strategy == "markdown":
                        head = f"[Section: {dict(c['metadata'])['breadcrumbs']}]\n"
                        ok["headed"] &= body.startswith(head)
                        body = body[len(head) :]
                        ok["long_enough"] &= len(body.split()) >= MIN_WORDS
                    ok["within_limit"] &= approximate_tokens(body) <= limit or (strategy == "markdown" and _TABLE.search(body) is not None)
                    found = source.find(body.split("\n")[0].strip()[:80] if strategy == "markdown" else body[:100])
                    ok["placed"] &= c["end_char"] - c["start_char"] == len(body) if found >= 0 else c["end_char"] == 0
                out.append((doc, strategy, header, *ok.values(), len({c["id"] for c in chunks}) == len(chunks), strategy == "recursive" and bool(chunks)))
            yield pd.DataFrame(out, columns=["doc_id", "strategy", "header", "headed", "within_limit", "placed", "long_enough", "distinct_ids", "has_chunks"])

    return rows.join(chunks, "doc_id", "left").mapInPandas(check, "doc_id string, strategy string, header string, headed boolean, within_limit boolean, placed boolean, long_enough boolean, distinct_ids boolean, has_chunks boolean")
