import os
import datetime as dt

from pyspark.sql import functions as F

import pytest
from docloom.operators import activity, chunking, corpus, embedding, sessions
from docloom.plans import chat

UTC = dt.timezone.utc


def at(day, hour=0):
    return dt.datetime(2025, 1, day, hour, tzinfo=UTC)


def test_latest_keeps_one(rows):
    df = rows([("a", 1, "x"), ("a", 2, "y"), (None, 1, "n")], "id string, v int, t string")
    assert {(r.id, r.t) for r in corpus.latest(df, "id", "v").collect()} == {("a", "y"), (None, "n")}


def test_duplicates_within_a_project(rows):
    s = "id string, project_id string, created_at timestamp, raw_text string"
    df = rows([("2", "p", at(2), "same  text"), ("1", "p", at(1), "same text "), ("3", "q", at(1), "same text"), ("4", "p", at(1), ""), ("5", "p", at(1), None), ("6", "p", at(1), " "), ("7", None, at(1), "n"), ("8", None, at(2), "n")], s)
    got = {r.id: (r.is_duplicate, r.first_id) for r in corpus.flag_duplicates(df).collect()}
    assert got["2"] == (True, "1") and got["1"] == (False, "1") and got["3"] == (False, "3")
    assert got["4"] == got["5"] == got["6"] == (False, None) and got["8"] == (True, "7") and len(got) == 8
    assert corpus.flag_duplicates(df.limit(0)).count() == 0


def test_labels(rows):
    df = rows([("web", "My github notes", "https://www.x.org/a"), ("PDF ", "a.pdf", None), (None, None, None), ("text", "b", "http://y.io")], "k string, t string, u string")
    got = df.select(corpus.effective_type(F.col("k"), F.col("t"), F.col("u")).alias("e"), corpus.icon(F.col("t"), F.col("k"), F.col("u")).alias("i"), corpus.host(F.col("u")).alias("h"), corpus.bare_url(F.col("u")).alias("b"), corpus.confidence(F.col("k")).alias("c")).collect()
    assert [tuple(r) for r in got] == [("repository", "repository", "x.org", "x.org/a", 2), ("pdf", "pdf", None, None, 3), (None, "web", None, None, None), ("text", "text", "y.io", "y.io", 3)]


def test_find_and_known(rows):
    docs = rows([("Alpha", None, "http://www.a.org"), (None, "beta", None)], "title string, summary string, source_url string")
    assert corpus.find(docs, " BETA ", "title", "summary").count() == 1 and corpus.find(docs, "", "title").count() == 2
    new = rows([("Alpha", "x"), ("New", "https://a.org"), ("Newer", "https://b.org"), ("Bare", None)], "title string, source_url string")
    assert {r.title for r in corpus.not_yet_known(new, docs).collect()} == {"Newer", "Bare"}


def test_delete_takes_what_hangs_on_it(rows):
    tables = {
        "projects": rows([("p",), ("q",)], "id string"),
        "project_documents": rows([("d", "p"), ("e", "q")], "id string, project_id string"),
        "chunks": rows([("c", "d", "p"), ("k", "e", "q")], "id string, doc_id string, project_id string"),
        "chunk_embeddings": rows([("v", "c"), ("w", "k")], "id string, chunk_id string"),
        "sessions": rows([("s", "p")], "id string, project_id string"),
        "session_messages": rows([("m", "s")], "id string, session_id string"),
    }
    left = corpus.delete(tables, "projects", rows([("p",)], "id string"))
    assert {n: [r.id for r in df.collect()] for n, df in left.items()} == {"projects": ["q"], "project_documents": ["e"], "chunks": ["k"], "chunk_embeddings": ["w"], "sessions": [], "session_messages": []}
    assert corpus.delete(tables, "chunks", rows([("none",)], "id string"))["chunk_embeddings"].count() == 2


def test_small_updates(rows):
    df = rows([("1", "old"), ("2", "other")], "id string, title string")
    assert {r.title for r in corpus.renamed(df, "1", "  new ").collect()} == {"new", "other"}
    assert {r.title for r in corpus.renamed(df, "1", "  ").collect()} == {"old", "other"}
    p = rows([("1", "a")], "id string, name string")
    assert corpus.created(p, rows([("2", "a"), ("3", "b")], "id string, name string")).count() == 2
    t = corpus.touched(df.withColumn("updated_at", F.lit("x")), rows([("1",)], "id string"), F.lit("now"))
    assert {(r.id, r.updated_at) for r in t.collect()} == {("1", "now"), ("2", "x")}
    pages = rows([("http://a", "http://a", "Title"), ("Kept", "http://a", "Title"), ("http://a", "http://a", None)], "title string, source_url string, parsed_title string")
    assert [r.title for r in corpus.retitled(pages).collect()] == ["Title", "Kept", "http://a"]


MESSAGES = [
    ("m1", "s", "user", "Which harbour crane was moved last winter?", at(1, 1)), ("m2", "s", "Assistant ", "The old crane was moved.", at(1, 2)), ("m3", "s", "User", "tell me more", at(1, 3)),
    ("m4", "s", "system", "note", at(1, 4)), ("m5", "s", "user", None, at(1, 5)), ("m6", "t", "assistant", "hello", at(1, 1)), ("m7", "t", "user", "and the second one?", at(1, 2)), ("m1", "s", "user", "Which harbour crane was moved last winter?", at(1, 1)),
]
MS = "id string, session_id string, role string, content string, created_at timestamp"


def test_history_and_rewriting(rows):
    turns = sessions.ordered(rows(MESSAGES, MS))
    assert turns.count() == 7
    h = {r.id: [m.role for m in r.history] for r in sessions.with_history(turns).collect()}
    assert h["m1"] == [] and h["m3"] == ["user", "assistant"] and h["m7"] == [] and h["m5"] == ["user", "assistant", "user", "system"]
    q = {r.id: r.search_query for r in sessions.rewritten(turns).collect()}
    assert q["m3"] == "[harbour crane moved last winter old] tell me more" and q["m7"] == "[hello] and the second one?" and q["m5"] is None


def test_pairs(rows):
    df = rows(MESSAGES, MS)
    ids = lambda *x: rows([(i,) for i in x], "id string")
    assert {r.id for r in sessions.pair_of(sessions.ordered(df), ids("m1")).collect()} == {"m1", "m2"}
    assert {r.id for r in sessions.pair_of(sessions.ordered(df), ids("m2")).collect()} == {"m1", "m2"}
    assert {r.id for r in sessions.pair_of(sessions.ordered(df), ids("m3", "m6", "gone")).collect()} == {"m3", "m6"}
    assert {r.id for r in sessions.without_pairs(df, ids("m1")).collect()} == {"m3", "m4", "m5", "m6", "m7"}


def test_listing_and_titles(rows):
    ss = rows([("s", "p", "New", at(1), None), ("t", "p", "New", at(1), at(9)), ("u", "p", "None", at(2), None)], "id string, project_id string, title string, created_at timestamp, updated_at timestamp")
    assert [(r.id, r.messages) for r in sessions.listing(ss, rows(MESSAGES, MS)).collect()] == [("t", 2), ("u", 0), ("s", 5)]
    assert {r.session_id: r.title for r in chat.titles(rows(MESSAGES, MS), ss).collect()}["t"] == "and the second one?"
    nested = {r.id: r.messages for r in sessions.nested(ss, rows(MESSAGES, MS)).collect()}
    assert [m.id for m in nested["t"]] == ["m6", "m7"] and nested["u"] is None


def test_timeline_edges(rows):
    now = F.lit("2025-01-31 12:00:00").cast("timestamp")
    docs = rows([("a", at(1, 13), "web", "p"), ("b", at(1, 11), "web", "p"), ("c", at(31, 1), "PDF", "gone"), ("d", None, "web", "p")], "id string, created_at timestamp, source_type string, project_id string")
    series = activity.timeline(docs, docs.limit(0), now).orderBy("date").collect()
    assert len(series) == 30 and series[0].date == "2025-01-02" and series[-1].documents == 1 and sum(r.documents for r in series) == 1
    # The oldest partial day is in the window, so it counts here.
    assert {(r.source_type, r.documents, r.share) for r in activity.type_counts(docs, now).collect()} == {("web", 1, 0.5), ("pdf", 1, 0.5)}
    assert {(r.name, r.documents) for r in activity.top_projects(docs, rows([("p", "Pumps")], "id string, name string"), now).collect()} == {("Pumps", 1), ("Unknown", 1)}
    total = activity.cumulative(activity.timeline(docs, docs, now)).orderBy("date").collect()
    assert total[-1].total == 1 and activity.last_rows(activity.timeline(docs, docs, now), 14).count() == 14


def test_splitting_and_offsets():
    count = chunking.approximate_tokens
    text = "\n\n".join(" ".join(f"word{i}{j}" for j in range(40)) for i in range(30))
    parts = chunking.split_text(text, count, 100, 20)
    assert all(count(p) <= 100 for p in parts) and all(p in text for p in parts) and parts[0].startswith("word00")
    assert chunking.split_text("") == [] and chunking.split_text(" \n ") == []
    assert max(map(count, chunking.split_text("x" * 5000, count, 100, 20))) <= 100


def test_markdown_chunks():
    prose = " ".join(f"w{i}" for i in range(20))
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| row{i} | {i} |" for i in range(400))
    text = f"# One\r\n{prose}\r\n\r\n## Two\n{prose} again\n\nshort\n\n### Three\ntoo short\n\n# Four\n{table}\n\n```\n# no heading\n```\n{prose}"
    chunks = chunking.chunk_markdown(text, "T")
    assert [c[5] for c in chunks][:2] == ["One", "One > Two"] and "One > Two > Three" not in {c[5] for c in chunks}
    whole = next(c for c in chunks if "row399" in c[0])
    assert "row0 " in whole[0] and whole[3] > 1.5 * chunking.LIMIT
    assert any("# no heading" in c[0] for c in chunks)
    source = text.replace("\r\n", "\n")
    for c in chunks[:2]:
        assert source[c[1] : c[2]].startswith("w0 w1") and c[0].startswith("[Source: T]\n[Section: ")
    repeated = chunking.chunk_markdown(f"# A\n{prose}\n# B\n{prose}")
    assert repeated[0][1] < repeated[1][1]
    again = chunking.chunk_recursive(f"{prose}\n\n{prose}", limit=30, overlap=0)
    assert again[0][1] == again[1][1] == 0


def test_chunk_documents(rows):
    s = "id string, project_id string, source_type string, title string, summary string, raw_text string, metadata string"
    docs = rows([("a", "p", "text", "T", "sum", "Some words here.", "x"), ("b", "p", None, None, None, "one " * 20, None), ("c", "p", "web", "T", None, None, None), ("d", "p", "web", "T", None, "  ", None)], s)
    got = chunking.chunk_documents(docs).collect()
    assert {(r.doc_id, r.strategy) for r in got} == {("a", "recursive"), ("b", "markdown")} and next(r for r in got if r.doc_id == "a").text == "[Source: T - sum]\nSome words here."
    assert {r.id for r in got} == {r.id for r in chunking.chunk_documents(docs).collect()}
    made = chunking.chunk_documents(docs).withColumn("created_at", F.lit(None).cast("timestamp"))
    assert chunking.rechunked(made, docs).count() == 2


def test_embedding_only_what_changed(rows):
    chunks = rows([("a", "text one"), ("b", "text two"), ("c", None), ("a", "text one")], "id string, text string")
    hashed = embedding.provider("hashed-words-384")
    from docloom.sources import store

    nothing = store.empty(chunks.sparkSession, "chunk_embeddings")
    first = embedding.embed_changed(chunks, nothing, hashed, F.lit("2025-01-01").cast("timestamp"))
    assert [r.is_cached for r in first.collect()] == [False, False] and all(len(r.vector) == 384 for r in first.collect())
    held = chunks.sparkSession.createDataFrame(first.drop("is_cached").collect(), nothing.schema)
    second = embedding.embed_changed(rows([("a", "text one"), ("b", "changed")], "id string, text string"), held, hashed, F.lit("2025-01-02").cast("timestamp"))
    assert {r.chunk_id: r.is_cached for r in second.collect()} == {"a": True, "b": False}
    assert abs(sum(x * x for x in hashed.embed_one("some words")) - 1) < 1e-6 and not any(hashed.embed_one("--"))
    try:
        embedding.provider("none")
    except KeyError as e:
        assert "hashed-words-384" in str(e)


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers/byte_bpe_50k.tiktoken"), reason="no vocabulary")
def test_chunks_by_a_vocabulary(rows):
    count = chunking.VocabularyCounter("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert count("Hello world, hello.") == 5 and count("") == 0
    docs = rows([("d", "p", "text", "T", None, "The harbour crane moved. " * 300)], "id string, project_id string, source_type string, title string, summary string, raw_text string")
    got = chunking.chunk_documents(docs, count, limit=100, overlap=10).collect()
    assert len(got) > 10 and all(count(r.text.split("\n", 1)[1]) <= 100 and r.token_count == count(r.text) for r in got)


def test_missing_rows_and_taken_names(rows):
    s = "id string, name string"
    projects = rows([("a", "One"), ("b", "Two")], s)
    assert corpus.require(projects, "a").first().name == "One"
    with pytest.raises(corpus.NotFound):
        corpus.require(projects, "x", "project")
    new = rows([("c", "Two"), ("d", "Three")], s)
    assert {(r.id, r.conflict) for r in corpus.conflicts(projects, new).collect()} == {("c", True), ("d", False)}
    assert {r.name for r in corpus.created(projects, new).collect()} == {"One", "Two", "Three"}
    with pytest.raises(corpus.Conflict):
        corpus.created(projects, new, strict=True)
    found = corpus.existing(projects, rows([("a",), ("x",), ("a",)], "id string")).collect()
    assert sorted((r.id, r.found) for r in found) == [("a", True), ("x", False)]
    assert corpus.existing(projects.limit(0), rows([("a",)], "id string")).first().found is False


def test_address_within_a_title(rows):
    known = rows([("https://www.a.example/page/one", None), ("Notes of b.example", None)], "title string, source_url string")
    new = rows([("n1", "http://a.example/page"), ("n2", "https://b.example"), ("n3", "https://c.example"), ("n4", "https://example/x"), ("n5", None)], "title string, source_url string")
    assert {r.title for r in corpus.not_yet_known(new, known).collect()} == {"n3", "n4", "n5"}
