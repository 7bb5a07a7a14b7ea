"""The tables of a workspace on disk: created, read with missing columns, replaced, reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The schema of each table.
SCHEMAS = {
    "projects": "id string, name string, description string, created_at timestamp, updated_at timestamp, last_indexed_at timestamp",
    "project_documents": "id string, project_id string, source_type string, title string, raw_text string, content_hash string, confidence_level int, source_url string, metadata map<string,string>, summary string, processing_status string, created_at timestamp, updated_at timestamp",
    "chunks": "id string, doc_id string, project_id string, text string, start_char int, end_char int, token_count int, strategy string, metadata map<string,string>, created_at timestamp",
    "chunk_embeddings": "id string, chunk_id string, model_name string, dimension int, content_hash string, vector array<float>, created_at timestamp",
    "sessions": "id string, project_id string, title string, created_at timestamp, updated_at timestamp",
    "session_messages": "id string, session_id string, role string, content string, citations array<struct<chunk_id:string,doc_id:string,text:string,score:double,start_char:int,end_char:int,strategy:string,doc_title:string,source_type:string,source_url:string,confidence_level:int>>, created_at timestamp",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    """A table of no rows."""
    return spark.createDataFrame([], SCHEMAS[name])


def _path(spark: SparkSession, root: str, name: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.parquet")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def init(spark: SparkSession, root: str) -> list[str]:
    """Makes the tables that aren't there and names them; calling it again changes nothing."""
    made = []
    for name in SCHEMAS:
        path, fs = _path(spark, root, name)
        if not fs.exists(path):
            empty(spark, name).write.parquet(str(path))
            made.append(name)
    return made


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table with all its columns: those that its files lack are null, extra ones are left out."""
    df = spark.read.option("mergeSchema", "true").parquet(f"{root}/{name}.parquet")
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty(spark, name).schema])


def replace(df: DataFrame, root: str, name: str) -> None:
    """A table replaced by ``df``, which may have been read from it: written beside it, then swapped."""
    spark = df.sparkSession
    path, fs = _path(spark, root, name)
    beside, _ = _path(spark, root, f".{name}-new")
    old, _ = _path(spark, root, f".{name}-old")
    df.write.mode("overwrite").parquet(str(beside))
    fs.delete(old, True)
    if fs.exists(path):
        fs.rename(path, old)
    if not fs.rename(beside, path):
        fs.rename(old, path)
        raise OSError(f"{name} could not be replaced")
    fs.delete(old, True)


def reset(spark: SparkSession, root: str) -> None:
    """All tables empty."""
    for name in SCHEMAS:
        replace(empty(spark, name), root, name)
