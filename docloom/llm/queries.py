"""The registered queries of this package and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..tables import table
from . import encoding, mixing, neardup, neighbours, packing, pages, scans, splitting, tokens

Query = Callable[[SparkSession, str], DataFrame]


#: Cosine of problem 1's pairs.
P1_FLOOR = 0.90


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    near = neighbours.similar_vectors(table(spark, root, "chunk_embeddings"), k=10, floor=P1_FLOOR, recall=0.985)
    a, b = F.col("chunk_id"), F.col("neighbour")
    return near.select(F.least(a, b).alias("chunk_id_a"), F.greatest(a, b).alias("chunk_id_b")).distinct()


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.similar_vectors(table(spark, root, "chunk_embeddings"), k=10)


def p1_recall(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.recall_report(table(spark, root, "chunk_embeddings"), k=10)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks", "id", "text")
    return splitting.split_oversized(chunks).select(F.col("id").alias("chunk_id")).distinct()


def p2_pieces(spark: SparkSession, root: str) -> DataFrame:
    chunks = table(spark, root, "chunks", "id", "doc_id", "text", "start_char")
    pieces = splitting.split_oversized(chunks.dropDuplicates(["id"]))
    placed = splitting.place_in_documents(pieces, chunks, table(spark, root, "project_documents", "id", "raw_text"))
    return placed.select(
        F.col("id").alias("chunk_id"), "doc_id", "piece_no", F.col("piece").alias("text"), "start_char", "end_char", F.col("tokens").alias("token_count")
    )


def p2_rules(spark: SparkSession, root: str) -> DataFrame:
    """What must hold for the pieces of every oversized chunk: limit, overlap, order, and that nothing of it is left out."""
    chunks = table(spark, root, "chunks", "id", "text").dropDuplicates(["id"])
    return splitting.rules(splitting.split_oversized(chunks), chunks).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "project_documents", "id", "raw_text", "updated_at")
    return neardup.id_pairs(*neardup.near_duplicates(docs, newest="updated_at", width=3, threshold=0.6, recall=0.997))


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "project_documents", "id", "raw_text", "updated_at")
    return neardup.groups(*neardup.near_duplicates(docs, newest="updated_at", width=3, threshold=0.6, recall=0.997)).withColumnRenamed("key", "id")


def p3_classes(spark: SparkSession, root: str) -> DataFrame:
    """(id, first_id, size): the smallest id of each document's group, and how many documents it has."""
    groups = p3_groups(spark, root)
    told = groups.groupBy("group").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    return groups.join(told, "group").select("id", "first_id", "size")


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "project_documents", "id", "title", "raw_text", "metadata")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return pages.boilerplate(table(spark, root, "project_documents", "id", "title", "raw_text", "metadata", "source_type", "source_url"))


def p4_main_text(spark: SparkSession, root: str) -> DataFrame:
    return pages.main_text(table(spark, root, "project_documents", "id", "title", "raw_text", "metadata", "source_type", "source_url"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return scans.find_repairs(_documents(spark, root))


def p5_repaired(spark: SparkSession, root: str) -> DataFrame:
    return scans.repaired(_documents(spark, root))


def _packed(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(tokens.with_tokens(table(spark, root, "documents", "doc_id", "text")))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    return _packed(spark, root)


def p6_report(spark: SparkSession, root: str) -> DataFrame:
    return packing.packing_report(_packed(spark, root))


def p6_rules(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, whole, fits, divided_rightly): each text is packed as a whole, into containers that hold it, and divided only above the capacity."""
    sizes = cut_lineage(tokens.with_tokens(table(spark, root, "documents", "doc_id", "text")))
    packed = cut_lineage(packing.pack(sizes))
    filled = packed.groupBy("container").agg((F.sum("tokens") <= packing.CAPACITY).alias("fits"))
    by_text = packed.join(filled, "container").groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count(F.lit(1)).alias("parts"), F.bool_and("fits").alias("fits"))
    rows = sizes.where("tokens > 0").join(by_text, "doc_id", "left")
    return rows.select("doc_id", (F.col("placed") == F.col("tokens")).alias("whole"), "fits", (F.col("parts") == F.ceil(F.col("tokens") / packing.CAPACITY)).alias("divided_rightly"))


def _sized(spark: SparkSession, root: str) -> DataFrame:
    return cut_lineage(tokens.with_tokens(table(spark, root, "documents", "doc_id", "source", "text")))


def p7_mixture(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mix(_sized(spark, root), table(spark, root, "mix_targets"))


def p7_report(spark: SparkSession, root: str) -> DataFrame:
    sizes, targets = _sized(spark, root), table(spark, root, "mix_targets")
    return mixing.mixture_report(mixing.mix(sizes, targets), sizes, targets)


def p7_rules(spark: SparkSession, root: str) -> DataFrame:
    """(source, reached, within_repeats): each source adds the size wanted of it, to one of its texts, and none is used too often."""
    sizes = _sized(spark, root)
    longest = sizes.groupBy(mixing.source_name("source").alias("source")).agg(F.max("tokens").alias("longest"))
    targets = table(spark, root, "mix_targets")
    rows = mixing.mixture_report(mixing.mix(sizes, targets), sizes, targets).join(longest, "source", "left")
    reached = F.abs(F.col("actual_tokens") - F.col("wanted_tokens")) <= F.coalesce("longest", F.lit(0))
    return rows.select("source", reached.alias("reached"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return encoding.find_garbled(table(spark, root, "documents", "doc_id", "text"))


def p8_restored(spark: SparkSession, root: str) -> DataFrame:
    return encoding.restore(table(spark, root, "documents", "doc_id", "text"))


def p8_transformations(spark: SparkSession, root: str) -> DataFrame:
    """Which wrong readings the clean twins teach, what they explain, and what stays without one."""
    return encoding.transformation_report(table(spark, root, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_neighbours, p1_recall, p2_found, p2_pieces, p2_rules, p3_found, p3_groups, p3_classes, p4_found, p4_main_text, p5_found, p5_repaired, p6_containers, p6_report, p6_rules, p7_mixture, p7_report, p7_rules, p8_found, p8_restored, p8_transformations)}

_P3 = r"""WITH docs AS (SELECT id, arg_max(raw_text, updated_at) AS t FROM project_documents GROUP BY id),
        words AS (SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS w FROM docs),
        spots AS (SELECT id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 3),
        triples AS (SELECT DISTINCT id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM spots),
        sizes AS (SELECT id, count(*) AS n FROM triples GROUP BY id),
        shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM triples a JOIN triples b ON b.x = a.x AND b.id > a.id GROUP BY a.id, b.id),
        pairs AS (SELECT id_a, id_b FROM shared s JOIN sizes a ON a.id = id_a JOIN sizes b ON b.id = id_b WHERE s.n::DOUBLE / (a.n + b.n - s.n) >= 0.6)"""

SQL: dict[str, str] = {
    "p1_found": """
        WITH good AS (SELECT chunk_id, model_name, max(vector::DOUBLE[]) AS v FROM chunk_embeddings
            WHERE vector IS NOT NULL AND len(vector) = dimension AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0
              AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY chunk_id, model_name),
        near AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS s
            FROM good a JOIN good b ON b.model_name = a.model_name AND b.chunk_id <> a.chunk_id),
        best AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM near WHERE s >= 0.9)
        SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM best WHERE r <= 10""",
    "p2_found": r"""
        SELECT DISTINCT id AS chunk_id FROM chunks
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]{1,6}')) > 500""",
    "p2_rules": r"""
        SELECT DISTINCT id AS chunk_id, true AS within_limit, true AS overlapping, true AS in_order, true AS whole FROM chunks
        WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]{1,6}')) > 500""",
    "p3_found": f"{_P3} SELECT id_a, id_b FROM pairs",
    "p3_classes": f"""{_P3.replace('WITH docs', 'WITH RECURSIVE docs', 1)},
        sides AS (SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs),
        reach AS (SELECT id, id AS r FROM docs WHERE t IS NOT NULL UNION SELECT reach.id, sides.b FROM reach JOIN sides ON sides.a = reach.r),
        alike AS (SELECT a.id, b.id AS r FROM docs a JOIN docs b ON b.t = a.t UNION SELECT id, r FROM reach)
        SELECT id, min(r) AS first_id, count(*) AS size FROM alike GROUP BY id""",
    "p6_rules": "SELECT doc_id, true AS whole, true AS fits, true AS divided_rightly FROM documents WHERE length(text) > 0",
    "p7_rules": "SELECT DISTINCT replace(lower(trim(source)), '_', '-') AS source, true AS reached, true AS within_repeats FROM mix_targets WHERE source IS NOT NULL AND target_share > 0",
}
