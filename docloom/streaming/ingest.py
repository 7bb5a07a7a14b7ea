"""Documents and activity as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..operators import chunking, corpus, embedding
from ..sources import parsers, store

#: The states of a document on its way, each with the one that follows when it goes well.
STEPS = {"parsing": "chunking", "chunking": "embedding", "embedding": "ready"}
#: Where a document stays.
ENDS = ("ready", "failed", "duplicate")
STATES = (*STEPS, *ENDS)


def next_state(status: Column) -> Column:
    """The state after ``status`` when its step went well; an end stays, and so does what is no state."""
    status = F.lower(F.trim(status))
    out = F.when(F.lit(False), "")
    for state, following in STEPS.items():
        out = out.when(status == state, following)
    return out.otherwise(status)


def is_done(status: Column) -> Column:
    """Whether a document is at its end."""
    return F.lower(F.trim(status)).isin(*ENDS)


def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files (path, modificationTime, length, content) that land under ``folder``, each in a folder named by its project."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)


#: What the rows of a batch of documents have beside the table's columns: why one couldn't be read.
ERROR = "error"


def _documents(parsed: DataFrame, key: Column, title: Column, kind: Column, url: Column, at: Column) -> DataFrame:
    """Parsed rows as rows of ``project_documents`` that are still to be chunked, with their ``error``."""
    facts = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("complexity"), F.coalesce("complexity", F.lit(""))))
    paged = F.when(F.lower(kind).isin("pdf", "pptx"), F.map_concat(facts, F.create_map(F.lit("page_count"), F.coalesce(F.col("page_count").cast("string"), F.lit("1"))))).otherwise(facts)
    return parsed.select(
        F.substring(F.sha2(key, 256), 1, 12).alias("id"), "project_id", kind.alias("source_type"), title.alias("title"), F.col("text").alias("raw_text"), F.lit("").alias("content_hash"), corpus.confidence(kind).alias("confidence_level"),
        url.alias("source_url"), paged.alias("metadata"), F.lit(None).cast("string").alias("summary"), F.lit("chunking").alias("processing_status"), at.alias("created_at"), at.alias("updated_at"), F.col("error").alias(ERROR),
    )


def documents_of_files(files: DataFrame) -> DataFrame:
    """Files (path, modificationTime, content) read as documents; the folder that holds a file names its project.

    A file that can't be read, or has no known type, is a document without text that tells its ``error``.
    """
    parsed = parsers.parse_files(files).withColumn("project_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return _documents(parsed, F.concat_ws("|", "path", F.col("modificationTime").cast("string")), name, F.col("source_type"), F.lit(None).cast("string"), F.col("modificationTime"))


def documents_of_pages(pages: DataFrame) -> DataFrame:
    """Fetched pages (project_id, url, html, fetched_at) read as documents; a page's own title takes the place of its address."""
    parsed = parsers.parse_pages(pages.select("url", "html")).dropDuplicates(["url"]).join(pages.select("project_id", "url", "fetched_at"), "url")
    parsed = parsed.withColumn("error", F.when(F.length("text") == 0, "the page has no text"))
    return _documents(parsed, F.concat_ws("|", "project_id", "url", F.col("fetched_at").cast("string")), F.coalesce(F.nullif("title", F.lit("")), F.col("url")), F.lit("web"), F.col("url"), F.col("fetched_at"))


def landing(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of new documents: Parquet files of the documents' schema that land in a folder."""
    return spark.readStream.schema(store.empty(spark, "project_documents").schema).parquet(folder)


def process(new: DataFrame, known: DataFrame, embedder: embedding.Embedder, now) -> dict[str, DataFrame]:
    """What one batch of documents becomes: ``project_documents``, ``chunks`` and ``chunk_embeddings`` to add.

    Texts known to their project, or earlier in the batch, are duplicates; blank ones have
    failed; neither has chunks. Rows whose id is known already are dropped. Of the known
    documents the ids and the hashes stored with ready ones are read, never their texts.
    """
    fresh = corpus.latest(new, "id", "updated_at").join(known.select("id"), "id", "left_anti")
    flags = corpus.flag_duplicates(fresh.select("id", "project_id", "created_at", "raw_text")).select("id", F.col("content_hash").alias("__hash"), "is_duplicate")
    ready = known.where("processing_status = 'ready'")
    held = ready.select("project_id", F.lower(F.trim("content_hash")).alias("__hash"), F.lit(True).alias("held")).distinct()
    rows = fresh.join(flags, "id").join(held, ["project_id", "__hash"], "left")
    status = F.when(F.col("__hash").isNull(), "failed").when(F.col("is_duplicate") | F.coalesce("held", F.lit(False)), "duplicate").otherwise("ready")
    docs = rows.withColumn("processing_status", status).withColumn(
        "content_hash", F.when(status == "ready", F.col("__hash")).otherwise(F.concat(F.lit("pending_"), F.substring(F.sha2("id", 256), 1, 32)))
    ).select(*fresh.columns)
    chunks = chunking.chunk_documents(docs.where("processing_status = 'ready'")).withColumn("created_at", now)
    vectors = embedding.embed_changed(chunks, store.empty(new.sparkSession, "chunk_embeddings"), embedder, now).drop("is_cached")
    return {"project_documents": docs, "chunks": chunks, "chunk_embeddings": vectors}


def _marked(spark: SparkSession, folder: str, number: int) -> bool:
    """Whether the batch was begun before; marks it as begun."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/begun/{number}")
    return not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(path)


def start(stream: DataFrame, root: str, checkpoint: str, embedder: embedding.Embedder | None = None, on_batch: Callable[[int], None] | None = None, read: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Ingests all that has landed and stops: each batch is read, deduplicated, chunked, embedded and added.

    ``read`` makes documents of what the stream holds, as :func:`documents_of_files` does;
    without it the stream holds documents. What can't be read is a failed document and a row
    of ``quarantine`` with its error. Projects with new documents are marked as indexed, and
    their new chunks give the keyword index another version. A batch that is delivered again
    adds nothing: its documents are known by id, and what it had written of them before it
    was lost is looked up for such a batch only.
    """
    embedder = embedder or embedding.HashedWords()

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        again = _marked(spark, checkpoint, number)
        documents = (read(batch) if read else batch.withColumn(ERROR, F.lit(None).cast("string"))).persist()
        try:
            now = F.lit(documents.agg(F.max("updated_at")).first()[0]).cast("timestamp")
            made = process(documents.drop(ERROR), store.read(spark, root, "project_documents"), embedder, now)
            # The documents go last: until they are there the batch counts as not done.
            ready = {name: made[name].select(*store.empty(spark, name).columns).persist() for name in ("chunk_embeddings", "chunks", "project_documents")}
            lost = documents.where(F.col(ERROR).isNotNull()).join(ready["project_documents"].select("id"), "id", "left_semi").select("id", "project_id", "title", ERROR, F.col("updated_at").alias("at"))
            lost.write.mode("append").parquet(f"{root}/quarantine.parquet")
            projects = ready["project_documents"].where("processing_status = 'ready'").select(F.col("project_id").alias("id")).distinct()
            if not projects.isEmpty():
                store.replace(corpus.touched(store.read(spark, root, "projects"), projects, now, "last_indexed_at"), root, "projects")
            for name, df in ready.items():
                if again:
                    df = df.join(store.read(spark, root, name).select("id"), "id", "left_anti")
                df.write.mode("append").parquet(f"{root}/{name}.parquet")
            for df in ready.values():
                df.unpersist()
        finally:
            documents.unpersist()
        if on_batch:
            on_batch(number)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(query: StreamingQuery) -> dict:
    """How far a stream has come: whether it runs, its last batch, rows read in it, and its error."""
    last = query.lastProgress
    error = query.exception()
    return {"active": query.isActive, "batch": last.batchId if last else None, "rows": last.numInputRows if last else 0, "error": str(error) if error else None}


def once(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of a stream over all that there is now, for results that fit the driver, such as counts by day."""
    name = f"once_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first of each text in its project, as a stream: state is kept for the time a copy may be late."""
    hashed = stream.withColumn("content_hash", content_hash("raw_text")).withWatermark("created_at", delay)
    return hashed.dropDuplicatesWithinWatermark(["project_id", "content_hash"])


def daily_activity(events: DataFrame, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """(day, event_type, events) as a stream; a day is told once no more of it can be late. An extension of the batch timeline."""
    seen = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counts = seen.groupBy(F.window(time, "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events")
