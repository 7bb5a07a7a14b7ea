"""Keyword search: BM25 over the chunks of each project, many queries at once."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import checkpoint_dir, cut_lineage, of_existing, once, sent

#: Constants of the scoring function.
K1, B, EPSILON = 1.5, 0.75, 0.25


#: Chunks of a cell, cells and queries that a task holds at a time.
CHUNKS, TOGETHER, QUERIES = 16_384, 4, 2_048


@dataclass(frozen=True)
class Index:
    """Postings (project_id, cell, term, df, places, tfs), terms (project_id, term, df, idf, cells), projects (project_id, n, avgdl, mean_idf) and cells (project_id, cell, chunk_ids, doc_ids, start_chars, lengths).

    A project's chunks are cut into cells of about ``CHUNKS``. A row of the postings has a
    word's chunks in a cell, by their places in the lists of ``cells``, and how often it is in
    each, as packed numbers; ``terms.cells`` are the cells that hold a word.
    """

    postings: DataFrame
    terms: DataFrame
    projects: DataFrame
    cells: DataFrame


_PACKED = "project_id string, cell int, term string, df int, places binary, tfs binary, chunk_ids array<string>, doc_ids array<string>, start_chars array<int>, lengths array<int>"
_POSTINGS, _CELLS = ["project_id", "cell", "term", "df", "places", "tfs"], ["project_id", "cell", "chunk_ids", "doc_ids", "start_chars", "lengths"]


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the fewest bytes that hold them all."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _wide(packed: pa.ChunkedArray, df: np.ndarray) -> np.ndarray:
    """The numbers of packed lists of ``df`` numbers each, all of one cell, one after another."""
    data = b"".join(packed.to_pylist())
    return np.frombuffer(data, f"<u{max(1, len(data) // max(1, df.sum()))}").astype(np.int64)


def _pack(rows: pa.Table) -> pa.Table:
    """A cell's chunks with their words as a row that lists the chunks, without a term, and a row for each word."""
    schema = pa.schema([("project_id", pa.string()), ("cell", pa.int32()), ("term", pa.string()), ("df", pa.int32()), ("places", pa.binary()), ("tfs", pa.binary()), ("chunk_ids", pa.list_(pa.string())), ("doc_ids", pa.list_(pa.string())), ("start_chars", pa.list_(pa.int32())), ("lengths", pa.list_(pa.int32()))])
    rows = rows.combine_chunks()
    words = rows.column("words").chunk(0)
    lengths, coded = pc.list_value_length(words).to_numpy(), words.flatten().dictionary_encode()
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(rows) + np.repeat(np.arange(len(rows)), lengths), return_counts=True)
    df = np.bincount(key // len(rows), minlength=len(coded.dictionary))
    ends = np.concatenate([[0], np.cumsum(df)])

    def lists(numbers: np.ndarray) -> pa.Array:
        numbers = _narrow(numbers)
        offsets = (ends * numbers.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(df), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(numbers.tobytes())])

    project, cell = rows.column("project_id")[0].as_py(), rows.column("cell")[0].as_py()
    said = pa.table([pa.array([project] * len(df), pa.string()), pa.array([cell] * len(df), pa.int32()), coded.dictionary, pa.array(df, pa.int32()), lists(key % len(rows)), lists(tf), *(pa.nulls(len(df), f.type) for f in list(schema)[6:])], schema=schema)
    head = {"project_id": project, "cell": cell} | {c: rows.column(c[:-1]).to_pylist() for c in ("chunk_ids", "doc_ids", "start_chars")} | {"lengths": lengths.tolist()}
    return pa.concat_tables([pa.Table.from_pylist([head], schema=schema), said.sort_by("term")])


def _packed(chunks: DataFrame) -> DataFrame:
    """The postings and cells of ``chunks`` in one table. A text moves once, to its cell, and is taken apart there."""
    n_cells = sent(chunks.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / CHUNKS).cast("int").alias("n_cells")))
    cell = F.pmod(F.xxhash64("id"), F.col("n_cells")).cast("int").alias("cell")
    placed = once(chunks).join(n_cells, "project_id").select("project_id", cell, F.col("id").alias("chunk_id"), "doc_id", F.col("start_char").cast("int").alias("start_char"), "text")
    words = placed.repartition("project_id", "cell").withColumn("words", tokens(F.coalesce("text", F.lit("")))).drop("text")
    return words.groupBy("project_id", "cell").applyInArrow(_pack, _PACKED)


def _derived(packed: DataFrame) -> Index:
    postings, cells = packed.where("term IS NOT NULL").select(*_POSTINGS), packed.where("term IS NULL").select(*_CELLS)
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    projects = sent(cells.groupBy("project_id").agg(F.sum(F.size("lengths")).alias("n"), F.sum(total).alias("words")).select("project_id", "n", (F.col("words") / F.col("n")).alias("avgdl")))
    df = postings.groupBy("project_id", "term").agg(F.sum("df").alias("df"), F.collect_set("cell").alias("cells"))
    n = F.col("n")
    raw = df.join(projects, "project_id").withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    means = sent(raw.groupBy("project_id").agg(F.avg("raw").alias("mean_idf")))
    terms = raw.join(means, "project_id").select("project_id", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"), "cells")
    return Index(postings, terms, projects.join(means, "project_id", "left"), cells)


def build(chunks: DataFrame) -> Index:
    """The index of ``chunks`` (id, project_id, doc_id, start_char, text).

    Chunks delivered twice count once; chunks without words count towards the project's
    number and mean length. A negative idf is replaced by a share of the mean over the
    vocabulary.
    """
    # Everything derived reads the postings; the texts are taken apart once.
    return _derived(cut_lineage(_packed(chunks)))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, project_id, term, qf): the words of each query with their repeats."""
    words = F.explode(tokens(F.coalesce("text", F.lit(""))))
    return queries.select("query_id", "project_id", words.alias("term")).groupBy("query_id", "project_id", "term").agg(F.count(F.lit(1)).alias("qf"))


def _wanted(index: Index, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The postings of the words asked for, and (project_id, term, idf, avgdl, cells) of those words.

    Up to ``session.MOST_SENT`` different words are sent to the postings, which then stay
    where they are; beyond that both sides are shuffled.
    """
    wanted = sent(asked.select("project_id", "term").distinct())
    weights = index.terms.join(wanted, ["project_id", "term"], "left_semi").join(index.projects.select("project_id", "avgdl"), "project_id")
    return index.postings.join(wanted, ["project_id", "term"], "left_semi"), weights.select("project_id", "term", "idf", "avgdl", "cells")


def _part(idf, tf, dl, avgdl):
    """What a word adds to a chunk's score."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def _unpacked(cells: pa.Table, postings: pa.Table) -> pa.Table:
    """(project_id, term, chunk_id, tf, dl) of a cell's packed postings."""
    if not cells.num_rows or not postings.num_rows:
        return pa.schema([("project_id", pa.string()), ("term", pa.string()), ("chunk_id", pa.string()), ("tf", pa.int64()), ("dl", pa.int32())]).empty_table()
    df = postings.column("df").to_numpy()
    at = pa.array(_wide(postings.column("places"), df))
    chunk, dl = (pc.list_flatten(cells.column(c)).take(at) for c in ("chunk_ids", "lengths"))
    of = postings.select(["project_id", "term"]).take(pa.array(np.repeat(np.arange(len(df)), df)))
    return of.append_column("chunk_id", chunk).append_column("tf", pa.array(_wide(postings.column("tfs"), df))).append_column("dl", dl)


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, chunk_id, score, matched): every chunk of the query's project that holds one of its words.

    Scores are rounded to six places, the precision they are ranked by. A row per pair; for
    the best ones only, :func:`search` is far cheaper.
    """
    asked = query_terms(queries)
    postings, weights = _wanted(index, asked)
    cell = ["project_id", "cell"]
    cells, postings = index.cells.toDF(*_CELLS), postings.select(*_POSTINGS).toDF(*_POSTINGS)
    found = cells.groupBy(*cell).cogroup(postings.groupBy(*cell)).applyInArrow(_unpacked, "project_id string, term string, chunk_id string, tf long, dl int")
    part = _part(F.col("idf"), F.col("tf"), F.col("dl"), F.col("avgdl")).alias("part")
    return (
        asked.join(found.join(weights, ["project_id", "term"]).select("project_id", "term", "chunk_id", part), ["project_id", "term"])
        .groupBy("query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("qf") * F.col("part")), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    )


_TOP = "query_id string, chunk_id string, doc_id string, start_char int, score double, matched long"


#: Sums of a query and a chunk that are held at a time.
_SUMS = 4_000_000


_TOP_SCHEMA = pa.schema([("query_id", pa.string()), ("chunk_id", pa.string()), ("doc_id", pa.string()), ("start_char", pa.int32()), ("score", pa.float64()), ("matched", pa.int64())])


def _coded(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """The values of a column as numbers from 0, and what they stand for."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(), coded.dictionary


def _best_of_cells(k: int, order: str):
    """The ``k`` best chunks of each query within some cells; ties go to the order of the corpus."""

    def best(asked: pa.Table, found: pa.Table) -> pa.Table:
        if not asked.num_rows or not found.num_rows:
            return _TOP_SCHEMA.empty_table()
        asked, held = asked.combine_chunks(), pc.is_null(found.column("term"))
        cells, postings = found.filter(held), found.filter(pc.invert(held))
        about = pa.table({c: pc.list_flatten(cells.column(f"{c}s")) for c in ("chunk_id", "doc_id", "start_char")}).combine_chunks()
        dl = pc.list_flatten(cells.column("lengths")).to_numpy()
        # Chunks are numbered by the order that decides ties.
        by = pc.sort_indices(about, [(c, "ascending") for c in (("doc_id", "start_char", "chunk_id") if order == "score" else ("chunk_id",))]).to_numpy()
        about, place = about.take(by), np.empty(len(by), int)
        place[by] = np.arange(len(by))
        code, terms = _coded(asked.column("term"))
        _, one = np.unique(code, return_index=True)
        idf, avgdl = (asked.column(c).to_numpy()[one] for c in ("idf", "avgdl"))
        postings = postings.filter(pc.is_in(postings.column("term"), value_set=terms))
        term, chunk, tf, before = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0, int)], 0
        for cell, size in zip(cells.column("cell").to_pylist(), pc.list_value_length(cells.column("chunk_ids")).to_pylist()):
            mine = postings.filter(pc.equal(postings.column("cell"), cell))
            df = mine.column("df").to_numpy()
            term.append(np.repeat(pc.index_in(mine.column("term"), value_set=terms).to_numpy().astype(int), df))
            chunk.append(before + _wide(mine.column("places"), df))
            tf.append(_wide(mine.column("tfs"), df))
            before += size
        term, chunk, tf = map(np.concatenate, (term, chunk, tf))
        if not len(term):
            return _TOP_SCHEMA.empty_table()
        by_term = np.argsort(term, kind="stable")
        term, chunk, tf = term[by_term], chunk[by_term], tf[by_term]
        part, chunk = _part(idf[term], tf, dl[chunk], avgdl[term]), place[chunk]
        ends = np.cumsum(np.bincount(term, minlength=len(terms)))
        starts = np.concatenate([[0], ends[:-1]])
        query, names = _coded(asked.column("query_id"))
        qf, width, n_chunks = asked.column("qf").to_numpy(), ends - starts, len(place)
        out, step = [], max(1, _SUMS // n_chunks)
        for first in range(0, len(names), step):
            mine = (query >= first) & (query < first + step)
            c, n = code[mine], min(step, len(names) - first)
            size = width[c]
            rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[c], size)
            spot = np.repeat(query[mine] - first, size) * n_chunks + chunk[rows]
            score = np.bincount(spot, part[rows] * np.repeat(qf[mine], size), n * n_chunks).reshape(n, -1)
            matched = np.bincount(spot, minlength=n * n_chunks).reshape(n, -1)
            value = np.where(matched > 0, matched if order == "matched" else np.round(score, 6), -np.inf)
            least = np.partition(value, n_chunks - k, axis=1)[:, [n_chunks - k]] if n_chunks > k else -np.inf
            q, at = np.nonzero((value >= least) & (matched > 0))
            best_first = np.lexsort((at, -value[q, at], q))
            q, at = q[best_first], at[best_first]
            kept = np.arange(len(q)) - np.searchsorted(q, q) < k
            q, at = q[kept], at[kept]
            hit = about.take(at)
            columns = [names.take(q + first), hit.column("chunk_id"), hit.column("doc_id"), hit.column("start_char"), score[q, at], matched[q, at].astype(np.int64)]
            out.append(pa.table([pa.chunked_array([x]) if isinstance(x, pa.Array) else x if isinstance(x, pa.ChunkedArray) else pa.chunked_array([pa.array(x)]) for x in columns], names=_TOP_SCHEMA.names))
        return pa.concat_tables(out).cast(_TOP_SCHEMA)

    return best


def search(index: Index, queries: DataFrame, k: int = 10, order: str = "score") -> DataFrame:
    """(query_id, chunk_id, score, normalized, rank): the ``k`` best chunks of each query.

    Ties go to the order of the corpus: document, start, id. The normalised score is the
    score over the query's best one; chunks without a positive score are dropped after
    the cut, as the cut is over all. With ``order="matched"`` the number of the query's
    words that match decides, then the id.

    A project's chunks and queries are cut into parts of bounded size, and packed postings
    are sent to the parts of queries. All of a chunk's words lie in one cell, so its score
    is summed there and only ``k`` rows per query and ``TOGETHER`` cells are shuffled, not one
    for every pair of a query and a chunk.
    """
    asked = query_terms(queries)
    postings, weights = _wanted(index, asked)
    n_queries = sent(queries.groupBy("project_id").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qs")))
    spot = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    part = lambda c: F.floor(c / TOGETHER).cast("int")
    left = asked.join(weights, ["project_id", "term"]).join(n_queries, "project_id")
    left = left.select("project_id", spot("query_id", "qs").alias("q"), F.explode(F.array_distinct(F.transform("cells", part))).alias("part"), "query_id", "term", "qf", "idf", "avgdl")
    right = postings.unionByName(index.cells, allowMissingColumns=True).join(n_queries, "project_id")
    right = right.select(*_POSTINGS, *_CELLS[2:], part(F.col("cell")).alias("part"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"))
    keys = ["project_id", "q", "part"]
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)
    top = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_best_of_cells(k, order), _TOP).withColumn("score", F.round("score", 6))
    by = [F.desc("score"), "doc_id", "start_char", "chunk_id"] if order == "score" else [F.desc("matched"), "chunk_id"]
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= k)
    most = F.max("score").over(Window.partitionBy("query_id"))
    top = top.withColumn("normalized", F.round(F.col("score") / F.when(most > 0, most).otherwise(1.0), 6))
    return top.where("score > 0").select("query_id", "chunk_id", "score", "normalized", "rank")


#: The tables of a written index. Postings lie in the order of cells and words, as they were packed.
_TABLES = ("packed", "terms", "projects")


def write_index(index: Index, folder: str, version: str) -> None:
    """The index as tables of a version; a new version leaves the old one readable."""
    index.postings.unionByName(index.cells, allowMissingColumns=True).write.mode("overwrite").parquet(f"{folder}/{version}/packed")
    _write_derived(index, folder, version)


def _write_derived(index: Index, folder: str, version: str) -> None:
    for name in _TABLES[1:]:
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{version}/{name}")


def read_index(spark: SparkSession, folder: str, version: str) -> Index:
    """An index that was written."""
    packed, terms, projects = (spark.read.parquet(f"{folder}/{version}/{name}") for name in _TABLES)
    return Index(packed.where("term IS NOT NULL").select(*_POSTINGS), terms, projects, packed.where("term IS NULL").select(*_CELLS))


def version_of(spark: SparkSession, *tables: str) -> str:
    """A name for what the tables at these paths hold now, by the number, size and time of their files."""
    said = []
    for name in tables:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        held = fs.getContentSummary(path)
        said.append(f"{name} {held.getFileCount()} {held.getLength()} {fs.getFileStatus(path).getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:16]


def cached(chunks: DataFrame, version: str, folder: str | None = None, docs: DataFrame | None = None) -> Index:
    """The index of ``chunks`` as written under ``version``; built and written first if it isn't there.

    With ``docs`` (doc_id) only the chunks of those documents count.

    A table that changed has another version, so an index of what it held before is never
    read. The folder is by default one beside the checkpoints.
    """
    spark = chunks.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/keyword-index"
    jvm = spark.sparkContext._jvm
    done = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{version}/{name}/_SUCCESS") for name in _TABLES]
    if not all(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) for p in done):
        _packed(chunks if docs is None else of_existing(chunks, docs, "doc_id")).write.mode("overwrite").parquet(f"{folder}/{version}/packed")
        _write_derived(_derived(spark.read.parquet(f"{folder}/{version}/packed")), folder, version)
    return read_index(spark, folder, version)


def stale(current: DataFrame, indexed: DataFrame) -> DataFrame:
    """Projects (project_id) whose number of chunks or time of last indexing differs from what was indexed, or that weren't.

    Both tables have (project_id, n, last_indexed_at).
    """
    now, then = current.alias("now"), indexed.alias("then")
    same = (F.col("now.n") == F.col("then.n")) & F.col("now.last_indexed_at").eqNullSafe(F.col("then.last_indexed_at"))
    return now.join(then, "project_id", "left").where(F.col("then.n").isNull() | ~same).select("project_id")
