"""Counts and time series of a workspace. ``now`` is always given, so a query gives the same rows twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 30


def metrics(projects: DataFrame, docs: DataFrame, sessions: DataFrame, messages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals; rows delivered twice count once."""
    n = lambda df, name: df.agg(F.count_distinct("id").alias(name))
    tokens = chunks.groupBy("id").agg(F.first("token_count").alias("t")).agg(F.coalesce(F.sum("t"), F.lit(0)).cast("long").alias("total_tokens_ingested"))
    out = n(projects, "total_projects")
    # Each side is a single row.
    for part in (n(docs, "total_documents"), n(sessions, "total_sessions"), n(messages, "total_messages"), tokens):
        out = out.withColumn("__k", F.lit(1)).join(part.withColumn("__k", F.lit(1)), "__k").drop("__k")
    return out


def _recent(df: DataFrame, now: Column, days: int) -> DataFrame:
    return df.where(F.col("created_at") >= now - F.make_dt_interval(F.lit(days)))


def day_grid(df: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """(date) of the last ``days`` days up to today."""
    last = F.to_date(now)
    grid = df.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))
    return grid.select(F.date_format("date", "yyyy-MM-dd").alias("date"))


def timeline(docs: DataFrame, messages: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """(date, documents, messages) for each of the last ``days`` days, zero where there was nothing.

    Rows of the oldest partial day are within the window but not on the grid.
    """
    day = F.date_format("created_at", "yyyy-MM-dd").alias("date")
    count = lambda df, name: _recent(df, now, days).groupBy(day).agg(F.count(F.lit(1)).alias(name))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return day_grid(docs, now, days).join(count(docs, "documents"), "date", "left").join(count(messages, "messages"), "date", "left").select("date", zero("documents"), zero("messages"))


def cumulative(series: DataFrame) -> DataFrame:
    """(date, documents, total): the running total. The series has one row per day, so one task sorts it."""
    return series.select("date", "documents", F.sum("documents").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)).alias("total"))


def last_rows(series: DataFrame, n: int = 14) -> DataFrame:
    """The last ``n`` days of a series."""
    return series.withColumn("__r", F.row_number().over(Window.orderBy(F.desc("date")))).where(F.col("__r") <= n).drop("__r")


def type_counts(docs: DataFrame, now: Column, days: int = DAYS) -> DataFrame:
    """(source_type, documents, share) of the window, most frequent first."""
    counts = _recent(docs, now, days).groupBy(F.lower(F.trim("source_type")).alias("source_type")).agg(F.count(F.lit(1)).alias("documents"))
    share = F.round(F.col("documents") / F.sum("documents").over(Window.partitionBy()), 6)
    return counts.withColumn("share", share).orderBy(F.desc("documents"), "source_type")


def top_projects(docs: DataFrame, projects: DataFrame, now: Column, days: int = DAYS, k: int = 5) -> DataFrame:
    """(project_id, name, documents) of the ``k`` projects with most documents in the window; a project that isn't there is "Unknown"."""
    counts = _recent(docs, now, days).groupBy("project_id").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "project_id").limit(k)
    names = projects.select(F.col("id").alias("project_id"), "name")
    return counts.join(names, "project_id", "left").select("project_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "documents").orderBy(F.desc("documents"), "project_id")


def project_counts(projects: DataFrame, docs: DataFrame) -> DataFrame:
    """Projects with the number of their documents, 0 where there are none, last updated first."""
    counts = docs.groupBy("project_id").agg(F.count_distinct("id").alias("documents"))
    joined = projects.join(counts, projects["id"] == counts["project_id"], "left")
    return joined.select("id", "name", F.coalesce("documents", F.lit(0)).alias("documents"), "updated_at").orderBy(F.desc("updated_at"), "id")
