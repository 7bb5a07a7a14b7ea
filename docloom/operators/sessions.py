"""Sessions and messages: order, history windows, pairs, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import sanitize
from ..functions.text import expand_query

#: Messages of history that a turn sees, and those of them that a question is expanded with.
HISTORY, EXPANSION = 6, 4


def role(c: Column | str = "role") -> Column:
    """The role in its one spelling; what isn't the user's or the system's is the assistant's."""
    c = F.lower(F.trim(c))
    return F.when(c.isin("user", "system"), c).when(c.isNotNull(), "assistant")


def ordered(messages: DataFrame) -> DataFrame:
    """Messages, each once, with their ``role`` in one spelling and ``turn`` from 1 by time, then id, within the session."""
    once = messages.dropDuplicates(["id"])
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    return once.withColumn("role", role()).withColumn("turn", F.row_number().over(w))


def _before(n: int):
    return Window.partitionBy("session_id").orderBy("turn").rowsBetween(-n, -1)


def with_history(turns: DataFrame, most: int = HISTORY) -> DataFrame:
    """``turns`` with ``history``: the last ``most`` messages (role, content) before each, without a leading one that isn't the user's."""
    seen = F.collect_list(F.struct("role", F.coalesce("content", F.lit("")).alias("content"))).over(_before(most))
    lead = (F.size(seen) > 0) & ~F.coalesce(seen[0]["role"] == "user", F.lit(False))
    return turns.withColumn("history", F.when(lead, F.slice(seen, 2, most)).otherwise(seen))


def rewritten(turns: DataFrame, most: int = EXPANSION) -> DataFrame:
    """The user's messages with ``search_query``: vague ones expanded with key terms of the messages before."""
    texts = F.collect_list(F.coalesce("content", F.lit(""))).over(_before(most))
    return turns.withColumn("__h", texts).withColumn("search_query", expand_query(F.col("content"), F.col("__h"))).drop("__h").where("role = 'user'")


def prompt_messages(history: Column, question: Column, context: Column, system: Column) -> Column:
    """The messages of a prompt: the system's, the history with cleaned answers and without empty ones, and the question behind its sources."""
    said = F.transform(
        history, lambda m: F.struct(F.when(m["role"] == "user", "user").otherwise("assistant").alias("role"), F.when(m["role"] == "user", m["content"]).otherwise(sanitize(m["content"])).alias("content"))
    )
    said = F.filter(said, lambda m: F.length(m["content"]) > 0)
    one = lambda r, c: F.array(F.struct(F.lit(r).alias("role"), c.alias("content")))
    return F.concat(one("system", system), said, one("user", F.concat(context, F.lit("\n\nQuestion: "), question)))


def pair_of(turns: DataFrame, message_ids: DataFrame) -> DataFrame:
    """(id) of the messages ``message_ids`` (id), and of the other half of each question and answer."""
    w = Window.partitionBy("session_id").orderBy("turn")
    near = turns.withColumn("next", F.struct(F.lead("id").over(w).alias("id"), F.lead("role").over(w).alias("role"))).withColumn("last", F.struct(F.lag("id").over(w).alias("id"), F.lag("role").over(w).alias("role")))
    hit = near.join(message_ids.select("id").distinct(), "id", "left_semi")
    other = F.when((F.col("role") == "user") & (F.col("next.role") == "assistant"), F.col("next.id")).when((F.col("role") == "assistant") & (F.col("last.role") == "user"), F.col("last.id"))
    return hit.select(F.explode(F.array_compact(F.array("id", other))).alias("id")).distinct()


def without_pairs(messages: DataFrame, message_ids: DataFrame) -> DataFrame:
    """Messages without the pairs of ``message_ids``."""
    return messages.join(pair_of(ordered(messages), message_ids), "id", "left_anti").select(*messages.columns)


def listing(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with the number of their messages, by when they were last used; without an update by when they were made."""
    counts = messages.dropDuplicates(["id"]).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("messages"))
    used = F.coalesce("updated_at", "created_at").alias("last_used")
    return sessions.join(counts, "id", "left").select("id", "project_id", "title", used, F.coalesce("messages", F.lit(0)).alias("messages")).orderBy(F.desc("last_used"), "id")


def nested(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions with their messages as an ordered array."""
    item = F.struct("turn", "id", "role", "content", "created_at")
    rows = ordered(messages).groupBy(F.col("session_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("messages"))
    return sessions.join(rows, "id", "left")


def citation_groups(messages: DataFrame) -> DataFrame:
    """(message_id, doc_id, doc_title, numbers, first_number): an answer's citations by document, numbered from 1 as listed."""
    rows = messages.dropDuplicates(["id"]).select(F.col("id").alias("message_id"), F.posexplode("citations").alias("n", "c"))
    number = (F.col("n") + 1).alias("number")
    return (
        rows.select("message_id", "c.doc_id", "c.doc_title", number)
        .groupBy("message_id", "doc_id")
        .agg(F.min_by("doc_title", "number").alias("doc_title"), F.sort_array(F.collect_list("number")).alias("numbers"), F.min("number").alias("first_number"))
    )
