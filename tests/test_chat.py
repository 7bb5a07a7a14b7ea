import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import answering
from docloom.plans import chat

AT = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
CHUNKS = "id string, project_id string, doc_id string, start_char int, end_char int, strategy string, text string"
DOCS = "id string, title string, source_type string, source_url string, confidence_level int"


def corpus_of(rows):
    chunks = rows([("c1", "p", "d1", 0, 40, "markdown", "The harbour crane lifts the boats. It is old."), ("c2", "p", "d2", 0, 30, "markdown", "Bread is baked at night."), ("c3", "p", "d2", 40, 60, "markdown", "Salt and water."), ("c4", "p", "d2", 70, 90, "markdown", "It keeps a week.")], CHUNKS)
    return chunks, rows([("d1", "Crane", "text", None, 3), ("d2", "Bread", "text", None, 3)], DOCS)


def test_one_shot_answers(rows):
    class Broken(answering.Provider):
        def answer(self, system, prompt):
            raise OSError("down")

    chunks, docs = corpus_of(rows)
    asked = rows([("q1", "p", "What does the harbour crane lift?"), ("q2", "p", "zebra"), ("q3", "nowhere", "crane"), ("q4", "p", None)], "query_id string, project_id string, text string")
    got = {r.query_id: r for r in chat.one_shot(asked.where("text IS NOT NULL"), chunks, docs).collect()}
    assert got["q1"].sufficient and got["q1"].citations[0].doc_id == "d1" and "crane" in got["q1"].answer
    for q in ("q2", "q3"):
        assert got[q].answer == answering.NO_SOURCES and not got[q].sufficient and not got[q].citations
    failed = {r.query_id: r for r in chat.one_shot(asked.where("query_id = 'q1'"), chunks, docs, Broken()).collect()}["q1"]
    assert failed.answer == "Error generating answer: down" and not failed.sufficient


def test_a_question_asked_again_is_searched_once(rows, monkeypatch):
    chunks, docs = corpus_of(rows)
    asked = "What does the harbour crane lift at night?"
    messages = rows([("m1", "s", "user", asked, AT), ("m2", "t", "user", asked, AT), ("m3", "u", "user", asked, AT), ("m4", "t", "user", "zebra zebra zebra zebra zebra", AT + dt.timedelta(1))], "id string, session_id string, role string, content string, created_at timestamp")
    places = rows([("s", "p"), ("t", "p"), ("u", "q")], "id string, project_id string")
    seen, real = [], chat.searching.search
    monkeypatch.setattr(chat.searching, "search", lambda queries, *a, **k: (seen.append(queries.count()), real(queries, *a, **k))[1])
    got = {r.query_id: r for r in chat.replay(messages, places, chunks, docs).collect()}
    assert seen == [3] and set(got) == {"m1", "m2", "m3", "m4"}
    assert got["m1"].answer == got["m2"].answer != answering.NO_SOURCES and got["m1"].citations == got["m2"].citations and got["m1"].citations
    assert got["m3"].answer == got["m4"].answer == answering.NO_SOURCES and not got["m4"].citations


def test_turns_are_stored_once(spark, rows):
    messages = rows([("m1", "s", "user", "What does the crane lift?", None, AT)], "id string, session_id string, role string, content string, citations array<struct<chunk_id:string>>, created_at timestamp")
    answered = rows([("m1", "s", "What does the crane lift?", "Boats. [Source 1]")], "query_id string, session_id string, message string, answer string").withColumn("citations", F.array(F.struct(F.lit("c1").alias("chunk_id"))))
    once = chat.stored(messages, answered, F.lit(AT))
    twice = chat.stored(once, answered, F.lit(AT))
    assert sorted((r.role, r.content) for r in once.collect()) == [("assistant", "Boats. [Source 1]"), ("user", "What does the crane lift?"), ("user", "What does the crane lift?")]
    assert twice.count() == 3 and chat.stored(messages, answered.limit(0), F.lit(AT)).count() == 1
    said = {r.role: r for r in once.where("id <> 'm1'").collect()}
    assert said["assistant"].created_at > said["user"].created_at and said["assistant"].citations[0].chunk_id == "c1" and said["user"].citations is None


def test_a_new_session(rows):
    sessions = rows([("s", "p", "Old", AT, AT)], "id string, project_id string, title string, created_at timestamp, updated_at timestamp")
    more = chat.new_session(sessions, "t", "p", F.lit(AT))
    assert {(r.id, r.title) for r in more.collect()} == {("s", "Old"), ("t", "New chat")}
    assert chat.new_session(more, "t", "q", F.lit(AT), "Other").count() == 2
