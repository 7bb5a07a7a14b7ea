import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import answering
from docloom.sources import parsers, store
from docloom.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
AP = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_png", ".png"), content)
    return out.getvalue()


def docx():
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    return zipped(word__document_xml=f"<w:document {W}><w:body>{p('Name', 'Title')}{p('Part', 'Heading2')}{p('Words')}{table}</w:body></w:document>", word__media__x_png="x")


def pptx():
    shape = lambda text, kind="": f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    slide = f'<p:sld {AP}>{shape("Head", "<p:ph type=%stitle%s/>" % (chr(34), chr(34)))}{shape("Body")}<p:pic/></p:sld>'
    notes = f"<p:notes {AP}>{shape('Note')}</p:notes>"
    return zipped(ppt__slides__slide1_xml=slide, ppt__notesSlides__notesSlide1_xml=notes)


HTML = """<html><head><title> A page </title><style>x</style></head><body><nav><p>menu</p></nav><article>
<h1>Head</h1><p>One <b>two</b> <code>x</code><p>Unclosed<ul><li><p>Item</p></li></ul><pre><code>a = 1
b</code></pre><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td>single</td></tr></table></article><footer><p>foot</p></footer></body></html>"""


def test_html():
    got = parsers.parse_html(HTML, "http://a")
    parts = got["text"].split("\n\n")
    assert got["title"] == "A page" and parts[0] == "# Head" and "menu" not in got["text"] and "foot" not in got["text"]
    assert "- Item" in parts and "Item" in parts and "`x`" in parts and "```\na = 1\nb\n```" in got["text"]
    assert "| a | b |\n| --- | --- |\n| 1 | 2 |" in got["text"] and "single" not in got["text"].replace("Unclosed", "")[-200:].split("|")[-1] and got["has_tables"]
    assert any(p.startswith("Onetwo") for p in parts)
    bare = parsers.parse_html("<p>x", "http://a")
    assert bare["title"] == "http://a" and bare["text"] == "x" and parsers.parse_html("", "u")["text"] == ""


def test_office_files():
    word = parsers.parse_docx(docx())
    assert word["text"].startswith("# Name\n\n## Part\n\nWords\n\n| a | b |") and word["has_images"] and word["complexity"] == "full_pipeline"
    slides = parsers.parse_pptx(pptx())
    assert slides["text"] == "## Slide 1\n\n### Head\n\nBody\n\n> Note" and slides["page_count"] == 1 and slides["has_images"]


def test_text_and_pdf_rules():
    plain = parsers.parse_text(" a \n\n\n\n b ² ".encode(), False)
    assert plain["text"] == "a\n\nb ²" and plain["has_equations"] and plain["page_count"] == 1
    md = parsers.parse_text(b"| a | b |\n|---|---|\n| 1 | 2 |\n\n| x |\n\n![i](u) $x$\xff", True)
    assert md["tables"] == [[["a", "b"], ["1", "2"]]] and md["has_images"] and md["has_equations"]
    assert parsers.pdf_complexity(["word " * 10], 3) == "slide_mode" and parsers.pdf_complexity(["word " * 200], 0) == "text_only" and parsers.pdf_complexity(["word " * 200 + "\t" * 5], 0) == "full_pipeline"
    got = parsers.pdf_record(["word " * 400, " "], 1, [(1, [["a"], ["b"]]), (2, [["x"]])], [(1, 200, 150), (1, 20, 20)])
    assert got["text"].startswith("## Page 1") and "[Figure on page 1: 200 x 150]" in got["text"] and "20 x 20" not in got["text"] and got["has_tables"]
    with pytest.raises((ImportError, Exception)):
        parsers.parse_pdf(b"no pdf")


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nwords")
    (tmp_path / "b.TXT").write_text("x")
    (tmp_path / "c.csv").write_text("1,2")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.docx").write_bytes(docx())
    got = {r.path[-5:]: r for r in parsers.parse_files(parsers.scan_files(spark, str(tmp_path))).collect()}
    assert got["/a.md"].text == "# T\n\nwords" and got["b.TXT"].source_type == "text" and got[".docx"] is not None
    assert got["c.csv"].error.startswith("ValueError") and got["c.csv"].text is None
    rows = parsers.parse_files(parsers.scan_files(spark, str(tmp_path), "*.docx"))
    assert sorted(r.error is None for r in rows.collect()) == [False, True]


def test_pages_and_repositories(spark, rows, tmp_path):
    pages = parsers.parse_pages(rows([("u", HTML, 1), ("v", None, 2)], "url string, html string, text int")).collect()
    assert pages[0].title == "A page" and pages[1].text == ""
    root = tmp_path / "tool"
    (root / "pkg").mkdir(parents=True)
    (root / "README.md").write_text("# Tool")
    (root / "pkg" / "m.py").write_text('"""Module."""\nclass A:\n    """Class."""\n')
    (root / "bad.py").write_text("def (")
    got = parsers.parse_repository(parsers.scan_files(spark, str(root)), str(root)).collect()
    assert got[0].text == "# Tool\n\n## pkg/m.py\n\n**pkg/m.py**\n\nModule.\n\n**A**\n\nClass." and got[0].n_files == 2
    urls = rows([("https://github.com/o/r.git",), ("https://github.com/o/r/tree/x",), ("http://x.org",)], "u string")
    assert [r[0] for r in urls.select(parsers.repository_name(F.col("u"))).collect()] == ["o/r", "o/r", None]


def test_model_catalogue(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"data": [{"id": "a", "active": true}, {"id": "b", "active": false}]}')
    assert [r.id for r in parsers.model_catalogue(spark, str(tmp_path / "m.json")).collect()] == ["a", "b"]


def test_store(spark, tmp_path):
    root = str(tmp_path / "w")
    assert set(store.init(spark, root)) == set(store.SCHEMAS) and store.init(spark, root) == []
    spark.createDataFrame([("p", "n")], "id string, name string").write.mode("overwrite").parquet(f"{root}/projects.parquet")
    df = store.read(spark, root, "projects")
    assert df.columns[-1] == "last_indexed_at" and df.first().created_at is None
    store.replace(df.withColumn("name", F.lit("m")), root, "projects")
    assert store.read(spark, root, "projects").first().name == "m"
    store.reset(spark, root)
    assert store.read(spark, root, "projects").count() == 0


def test_streaming_ingest(spark, tmp_path):
    root, land, check = (str(tmp_path / x) for x in ("w", "land", "check"))
    store.init(spark, root)
    words = "The harbour crane was moved to the second quay before the winter and stayed there for a year. "
    cols = "id string, project_id string, source_type string, title string, raw_text string, created_at timestamp, updated_at timestamp"
    import datetime as dt

    at = lambda d: dt.datetime(2025, 1, d, tzinfo=dt.timezone.utc)

    def put(data):
        df = spark.createDataFrame(data, cols)
        full = store.empty(spark, "project_documents").unionByName(df, allowMissingColumns=True)
        full.coalesce(1).write.mode("append").parquet(land)

    put([("a", "p", "text", "A", words, at(1), at(1)), ("b", "p", "text", "B", words + " ", at(2), at(2)), ("c", "q", "text", "C", words, at(1), at(1)), ("d", "p", "text", "D", " ", at(1), at(1))])
    q = ingest.start(ingest.landing(spark, land), root, check)
    q.awaitTermination()
    put([("a", "p", "text", "A", words, at(1), at(3)), ("e", "p", "web", "E", words, at(4), at(4))])
    ingest.start(ingest.landing(spark, land), root, check).awaitTermination()
    docs = {r.id: r for r in store.read(spark, root, "project_documents").collect()}
    assert {k: v.processing_status for k, v in docs.items()} == {"a": "ready", "b": "duplicate", "c": "ready", "d": "failed", "e": "duplicate"}
    assert docs["b"].content_hash.startswith("pending_") and len(docs["a"].content_hash) == 64
    chunks = store.read(spark, root, "chunks").collect()
    assert {r.doc_id for r in chunks} == {"a", "c"} and len(chunks) == store.read(spark, root, "chunk_embeddings").count()


def test_streams_of_activity(spark, tmp_path):
    import datetime as dt

    at = lambda d, h=0: dt.datetime(2025, 1, d, h)
    folder = str(tmp_path / "e")
    spark.createDataFrame([(at(1, 1), "x"), (at(1, 2), "x"), (at(3), "y")], "ts timestamp, event_type string").write.parquet(folder)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(folder)
    name = f"days{int(time.time())}"
    q = ingest.daily_activity(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table(name).collect()] == [("2025-01-01", "x", 2)]


def test_providers():
    calls = []

    class Busy(Exception):
        status = 503

    class Flaky(answering.Provider):
        def __init__(self, fails, error=Busy):
            self.left, self.error = fails, error

        def answer(self, system, prompt):
            if self.left:
                self.left -= 1
                raise self.error("no")
            return "ok"

    assert answering.Retrying(Flaky(2), sleep=calls.append).answer("", "") == "ok" and calls == [1.0, 2.0]
    with pytest.raises(Busy):
        answering.Retrying(Flaky(3), sleep=calls.append).answer("", "")
    with pytest.raises(ValueError):
        answering.Retrying(Flaky(1, ValueError), sleep=calls.append).answer("", "")
    assert answering.Fallback(Flaky(1, ValueError), Flaky(0)).answer("", "") == "ok"
    with pytest.raises(ValueError):
        answering.Fallback(Flaky(1, ValueError), Flaky(1, KeyError)).answer("", "")


def test_answers_over_results(spark, rows):
    queries = rows([("q", "Where is it?"), ("n", "Nothing?")], "query_id string, text string")
    results = rows([("q", 1, "T", "u", "It is here. More.", 3, 9, 0.5), ("q", 2, None, None, "b", 0, 1, 0.25)], "query_id string, result_no int, doc_title string, source_url string, text string, start_char int, end_char int, score double")
    ctx = {r.query_id: r.context for r in answering.context_windows(queries, results).collect()}
    assert ctx["q"] == "[Source 1] T (u) | chars 3-9 | score: 0.5\nIt is here. More.\n\n---\n\n[Source 2]  | chars 0-1 | score: 0.25\nb" and ctx["n"].endswith("for: Nothing?")
    src = {r.query_id: r.sources for r in answering.source_blocks(queries, results).collect()}
    assert src["q"].startswith("--- SOURCES ---\n[Source 1] T (u):\nIt is here.") and src["n"] == "--- SOURCES ---"
    assert answering.FirstSource().answer("", src["q"]) == "It is here. [Source 1]"
    data = rows([("a", "x [2] y", 2), ("b", "I cannot answer", 2), ("c", "plain", 2), ("d", "plain", 0), ("e", "I cannot answer [1]", 1), ("f", "Error generating answer: x", 1)], "id string, answer string, n_sources int")
    got = {r.id: (r.answer, list(r.used), r.sufficient) for r in answering.grounded(data).collect()}
    assert got["a"] == ("x [Source 1] y", [2], True) and got["b"] == ("I cannot answer", [], False) and got["c"] == ("plain", [1, 2], True)
    assert got["d"] == (answering.NO_SOURCES, [], False) and got["e"][2] is True and got["f"] == ("Error generating answer: x", [], False)
    prompt = answering.system_prompt("chat", True)
    assert prompt != answering.system_prompt("chat") and len(prompt.split("\n\n")) == 7


def test_summaries(spark, rows):
    docs = rows([("a", "T", "First one. Second.", None), ("b", "T", "x", "kept"), ("c", None, None, "")], "id string, title string, raw_text string, summary string")
    assert [r.summary for r in answering.summarize(docs).orderBy("id").collect()] == ["First one.", "kept", None]

    class Down(answering.Provider):
        def answer(self, system, prompt):
            raise RuntimeError("down")

    assert answering.summarize(docs, Down()).orderBy("id").first().summary == "No summary available."


def test_files_are_ingested_end_to_end(spark, tmp_path):
    root, land, check = (tmp_path / x for x in ("w", "land", "check"))
    store.init(spark, str(root))
    import datetime as dt

    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    empty = store.empty(spark, "projects")
    spark.createDataFrame([("p", "P", None, at, at, None), ("q", "Q", None, at, at, None)], empty.schema).write.mode("append").parquet(f"{root}/projects.parquet")
    words = "The harbour crane was moved to the second quay before the winter and stayed there for a year. "
    for path, content in {"p/a.md": b"# Head\n\n" + words.encode(), "p/b.txt": words.encode(), "p/copy.txt": words.encode(), "p/x.bin": b"?", "p/broken.docx": b"no zip", "q/b.txt": words.encode()}.items():
        (land / path).parent.mkdir(parents=True, exist_ok=True)
        (land / path).write_bytes(content)
        time.sleep(0.01)
    run = lambda: ingest.start(ingest.landing_files(spark, str(land)), str(root), str(check), read=ingest.documents_of_files)
    query = run()
    query.awaitTermination()
    assert ingest.progress(query) == {"active": False, "batch": 0, "rows": 6, "error": None}
    docs = {(r.project_id, r.title): r for r in store.read(spark, str(root), "project_documents").collect()}
    status = {k: r.processing_status for k, r in docs.items()}
    assert status.pop(("p", "b.txt")) != status.pop(("p", "copy.txt")) and status == {("p", "a.md"): "ready", ("p", "x.bin"): "failed", ("p", "broken.docx"): "failed", ("q", "b.txt"): "ready"}
    lost = {r.title: r.error for r in spark.read.parquet(f"{root}/quarantine.parquet").collect()}
    assert set(lost) == {"x.bin", "broken.docx"} and "unsupported" in lost["x.bin"]
    assert store.read(spark, str(root), "projects").where("last_indexed_at IS NULL").count() == 0
    from docloom.operators import keyword

    version = keyword.version_of(spark, f"{root}/chunks.parquet")
    assert version == keyword.version_of(spark, f"{root}/chunks.parquet")
    # A copy of a known text and a new one: only the hashes of what is known are read.
    (land / "p/again.txt").write_bytes(words.encode())
    (land / "q/new.md").write_bytes(b"# Other\n\n" + words.upper().encode())
    run().awaitTermination()
    docs = {(r.project_id, r.title): r.processing_status for r in store.read(spark, str(root), "project_documents").collect()}
    assert docs["p", "again.txt"] == "duplicate" and docs["q", "new.md"] == "ready" and len(docs) == 8
    assert version != keyword.version_of(spark, f"{root}/chunks.parquet")
    plan = ingest.process(spark.read.parquet(f"{root}/project_documents.parquet"), store.read(spark, str(root), "project_documents"), ingest.embedding.HashedWords(), F.lit(None))["project_documents"]
    scans = [x for x in plan._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x and "processing_status" in x and "raw_text" not in x]
    assert scans


def test_pages_become_documents(spark, rows):
    import datetime as dt

    at = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
    pages = rows([("p", "https://a.example/x", HTML, at), ("p", "https://a.example/none", None, at)], "project_id string, url string, html string, fetched_at timestamp")
    got = {r.source_url: r for r in ingest.documents_of_pages(pages).collect()}
    page = got["https://a.example/x"]
    assert page.title == "A page" and page.source_type == "web" and page.confidence_level == 2 and page.error is None and "One" in page.raw_text
    assert got["https://a.example/none"].title == "https://a.example/none" and got["https://a.example/none"].error


def test_tables_of_a_page():
    page = "Intro line\nName\tYear\nCrane\t1902\nQuay   1910\n\nalone\there\nText again"
    assert parsers.page_tables(page) == [[["Name", "Year"], ["Crane", "1902"], ["Quay", "1910"]]]
    assert parsers.page_tables("") == []
