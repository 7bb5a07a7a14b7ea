"""Conversations replayed as a batch: every question of every session with its history and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_from
from ..operators import answering, sessions
from . import search as searching


def turns(messages: DataFrame, sessions_: DataFrame) -> DataFrame:
    """(query_id, session_id, project_id, turn, message, text, history): the user's messages as queries, vague ones expanded."""
    seen = sessions.with_history(sessions.ordered(messages))
    asked = sessions.rewritten(seen)
    place = sessions_.select(F.col("id").alias("session_id"), "project_id")
    return asked.join(place, "session_id").select(F.col("id").alias("query_id"), "session_id", "project_id", "turn", F.col("content").alias("message"), F.col("search_query").alias("text"), "history")


def replay(messages: DataFrame, sessions_: DataFrame, chunks: DataFrame, docs: DataFrame, provider: answering.Provider | None = None, own_knowledge: bool = False, **options) -> DataFrame:
    """(query_id, session_id, turn, prompt, answer, used, sufficient, citations): what each question would be answered now.

    The search runs once for all questions, and a question that is asked several times in a
    project is searched once. ``options`` go to the search; its floor is higher in a chat than
    in a plain search.
    """
    same = F.substring(F.sha2(F.to_json(F.struct("project_id", "text")), 256), 1, 32)
    asked = turns(messages, sessions_).withColumnRenamed("query_id", "message_id").withColumn("query_id", same)
    questions = asked.select("query_id", "project_id", "text").dropDuplicates(["query_id"])
    results = searching.search(questions, chunks, docs, **({"min_score": 0.35, "mode": "keyword"} | options))
    rows = answering.with_sources(asked, results)
    system = answering.system_prompt("chat", own_knowledge)
    rows = rows.withColumn("prompt", sessions.prompt_messages(F.col("history"), F.col("message"), F.col("sources"), F.lit(system)))
    ask = answering.raw_answers(provider or answering.FirstSource(), system)
    rows = rows.withColumn("answer", ask(F.concat("sources", F.lit("\n\nQuestion: "), "message")))
    out = answering.grounded(rows)
    cites = F.filter(F.transform("used", lambda n: F.get("results", n - 1)), lambda r: r.isNotNull())
    return out.select(F.col("message_id").alias("query_id"), "session_id", "turn", "prompt", "answer", "used", "sufficient", cites.alias("citations"))


def stored(messages: DataFrame, answered: DataFrame, now: Column) -> DataFrame:
    """``messages`` with two rows more for each turn of ``answered`` (query_id, session_id, message, answer, citations): the question and its answer.

    Ids are hashes of the turn and the role, so a turn stored again gives the same ids and
    adds nothing; the answer is later than the question.
    """
    name = lambda role: F.substring(F.sha2(F.concat("query_id", F.lit(f"/{role}")), 256), 1, 12).alias("id")
    none = F.lit(None).cast(dict(messages.dtypes)["citations"]).alias("citations")
    asked = answered.select(name("user"), "session_id", F.lit("user").alias("role"), F.col("message").alias("content"), none, now.alias("created_at"))
    said = answered.select(name("assistant"), "session_id", F.lit("assistant").alias("role"), F.col("answer").alias("content"), F.col("citations").cast(dict(messages.dtypes)["citations"]).alias("citations"), (now + F.expr("INTERVAL 1 MILLISECOND")).alias("created_at"))
    new = asked.unionByName(said).dropDuplicates(["id"]).join(messages.select("id"), "id", "left_anti")
    return messages.select(*new.columns).unionByName(new)


def new_session(sessions_: DataFrame, key: str, project: str, now: Column, title: str = "New chat") -> DataFrame:
    """``sessions_`` with one more; an id that is there already stays as it is."""
    one = sessions_.sparkSession.range(1).select(F.lit(key).alias("id"), F.lit(project).alias("project_id"), F.lit(title).alias("title"), now.alias("created_at"), now.alias("updated_at"))
    return sessions_.unionByName(one.join(sessions_.select("id"), "id", "left_anti").select(*sessions_.columns))


def one_shot(questions: DataFrame, chunks: DataFrame, docs: DataFrame, provider: answering.Provider | None = None, own_knowledge: bool = False, **options) -> DataFrame:
    """(query_id, answer, used, sufficient, citations): ``questions`` (query_id, project_id, text) answered without a conversation.

    A question without results gets the fixed answer, no citations, and isn't sufficient; a
    provider's error becomes the answer's text.
    """
    rows = answering.with_sources(questions, searching.search(questions, chunks, docs, **({"mode": "keyword"} | options)))
    ask = answering.raw_answers(provider or answering.FirstSource(), answering.system_prompt("oneshot", own_knowledge))
    out = answering.grounded(rows.withColumn("answer", ask(F.concat("sources", F.lit("\n\nQuestion: "), "text"))))
    cites = F.filter(F.transform("used", lambda n: F.get("results", n - 1)), lambda r: r.isNotNull())
    return out.select("query_id", "answer", "used", "sufficient", cites.alias("citations"))


def titles(messages: DataFrame, sessions_: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """(session_id, title): a session's title from its first user message, or the one ``proposed`` (session_id, answer)."""
    first = sessions.ordered(messages).where("role = 'user'").groupBy("session_id").agg(F.min_by("content", "turn").alias("message"))
    rows = first.join(proposed, "session_id", "left") if proposed is not None else first.withColumn("answer", F.lit(""))
    named = rows.select("session_id", title_from(F.coalesce("answer", F.lit("")), F.col("message")).alias("title"))
    return sessions_.select(F.col("id").alias("session_id")).join(named, "session_id")
