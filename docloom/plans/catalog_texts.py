"""Queries of documents, texts, chunks and streams with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, text
from ..operators import chunking, corpus, sessions
from ..sources import parsers
from ..streaming import ingest
from ..tables import table
from .catalog import _CHUNKS, _DOCS, _MSGS, _NORM, _SP, _STRIP, _TURNS, _chunks, _docs, _messages, _stamp, query

_UTC = lambda c: f"strftime({c} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"

# Workspace


@query("""WITH asked AS (SELECT DISTINCT id FROM (SELECT project_id AS id FROM sessions UNION ALL SELECT project_id FROM project_documents UNION ALL SELECT doc_id FROM chunks) WHERE id IS NOT NULL)
  SELECT a.id, p.id IS NOT NULL AS found FROM asked a LEFT JOIN projects p ON p.id = a.id""")
def existence_check(spark: SparkSession, root: str) -> DataFrame:
    """Which of the ids that other tables name are projects."""
    t = lambda n, c: table(spark, root, n, F.col(c).alias("id"))
    asked = t("sessions", "project_id").unionByName(t("project_documents", "project_id")).unionByName(t("chunks", "doc_id"))
    return corpus.existing(table(spark, root, "projects", "id"), asked.where("id IS NOT NULL"))


@query(f"""WITH {_DOCS} SELECT p.id, count(d.id) FILTER (WHERE coalesce(d.processing_status, 'ready') = 'ready') AS ready, count(d.id) FILTER (WHERE d.confidence_level = 3) AS trusted
  FROM projects p LEFT JOIN docs d ON d.project_id = p.id GROUP BY p.id""")
def filtered_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many documents of each project are ready, and how many were given as files."""
    docs = _docs(spark, root, "project_id", "processing_status", "confidence_level")
    ready = F.coalesce("processing_status", F.lit("ready")) == "ready"
    counts = docs.groupBy(F.col("project_id").alias("id")).agg(F.count_if(ready).alias("ready"), F.count_if(F.col("confidence_level") == 3).alias("trusted"))
    return table(spark, root, "projects", "id").join(counts, "id", "left").fillna(0)


@query(f"""WITH {_DOCS}, known AS (SELECT title, regexp_replace(source_url, '^(https?://)?(www\\.)?', '') AS bare FROM docs WHERE processing_status = 'ready'), new AS (SELECT id, title, source_url, regexp_replace(source_url, '^(https?://)?(www\\.)?', '') AS bare FROM docs WHERE processing_status <> 'ready')
  SELECT id FROM new n WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.title = n.title) AND NOT EXISTS (SELECT 1 FROM known k WHERE length(n.bare) > 0 AND contains(k.title, n.bare)) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.bare = n.bare)""")
def not_yet_known(spark: SparkSession, root: str) -> DataFrame:
    """Documents that aren't ready, and whose title and address no ready one has, nor the address in its title."""
    docs = _docs(spark, root, "title", "source_url", "processing_status")
    return corpus.not_yet_known(docs.where("processing_status <> 'ready'"), docs.where("processing_status = 'ready'")).select("id")


_FIRST_HEADING = "regexp_extract(raw_text, '(?m)^# ([^\\r\\n]+)', 1)"


@query(f"""WITH {_DOCS}, h AS (SELECT id, source_url, title, CASE WHEN source_url IS NOT NULL THEN source_url ELSE title END AS t, nullif({_FIRST_HEADING}, '') AS parsed FROM docs)
  SELECT id, CASE WHEN t = source_url AND parsed IS NOT NULL THEN parsed ELSE t END AS title FROM h""")
def retitled(spark: SparkSession, root: str) -> DataFrame:
    """Titles as they are when a page's address was its title until the page was read."""
    docs = _docs(spark, root, "title", "source_url", "raw_text")
    docs = docs.withColumn("title", F.coalesce("source_url", "title")).withColumn("parsed_title", F.nullif(F.regexp_extract("raw_text", r"(?m)^# ([^\r\n]+)", 1), F.lit("")))
    return corpus.retitled(docs).select("id", "title")


@query(f"""SELECT id, CASE WHEN id = (SELECT min(id) FROM projects) THEN 'The renamed one' ELSE name END AS name,
    CASE WHEN id IN (SELECT project_id FROM sessions WHERE updated_at IS NULL) THEN '2025-06-30 12:00:00' ELSE {_UTC('updated_at')} END AS updated_at FROM projects""")
def field_updates(spark: SparkSession, root: str) -> DataFrame:
    """A project renamed, with blanks around the new name, and those touched whose sessions were never updated."""
    from .catalog import _now

    projects = table(spark, root, "projects")
    first = projects.agg(F.min("id")).first()[0]
    hit = table(spark, root, "sessions").where("updated_at IS NULL").select(F.col("project_id").alias("id"))
    return corpus.touched(corpus.renamed(projects, first, "  The renamed one ", "name"), hit, _now()).select("id", "name", _stamp("updated_at"))


@query("""WITH new AS (SELECT title AS name, min(id) AS id FROM sessions WHERE title IS NOT NULL GROUP BY title UNION ALL SELECT name, 'x' || id FROM projects)
  SELECT n.id, n.name, EXISTS (SELECT 1 FROM projects p WHERE p.name = n.name) AS conflict FROM new n""")
def create_conflicts(spark: SparkSession, root: str) -> DataFrame:
    """Projects to be made, named as sessions and as projects are: the names that are taken are conflicts."""
    projects = table(spark, root, "projects", "id", "name")
    named = table(spark, root, "sessions", "id", "title").where("title IS NOT NULL").groupBy(F.col("title").alias("name")).agg(F.min("id").alias("id"))
    return corpus.conflicts(projects, named.unionByName(projects.select("name", F.concat(F.lit("x"), "id").alias("id"))))


@query(f"""WITH {_DOCS} SELECT id, processing_status AS status, CASE lower(trim(processing_status)) WHEN 'parsing' THEN 'chunking' WHEN 'chunking' THEN 'embedding' WHEN 'embedding' THEN 'ready' ELSE lower(trim(processing_status)) END AS next,
    lower(trim(processing_status)) IN ('ready', 'failed', 'duplicate') AS done FROM docs""")
def status_steps(spark: SparkSession, root: str) -> DataFrame:
    """Where each document goes from its state, and whether it is at its end."""
    status = F.col("processing_status")
    return _docs(spark, root, "processing_status").select("id", status.alias("status"), ingest.next_state(status).alias("next"), ingest.is_done(status).alias("done"))


@query(f"""WITH {_TURNS}, old AS (SELECT id, session_id, role FROM msgs), asked AS (SELECT t.id, t.session_id FROM turns t JOIN sessions s ON s.id = t.session_id WHERE t.role = 'user')
  SELECT id, session_id, role FROM old UNION ALL SELECT substr(sha256(id || '/user'), 1, 12), session_id, 'user' FROM asked UNION ALL SELECT substr(sha256(id || '/assistant'), 1, 12), session_id, 'assistant' FROM asked""")
def turns_stored(spark: SparkSession, root: str) -> DataFrame:
    """The messages after every question was asked once more and stored with its answer."""
    from . import chat
    from .catalog import _now

    messages = _messages(spark, root)
    asked = chat.turns(messages, table(spark, root, "sessions"))
    answered = asked.select("query_id", "session_id", "message", F.lit("").alias("answer"), F.array().cast(dict(messages.dtypes)["citations"]).alias("citations"))
    return chat.stored(messages, answered, _now()).select("id", "session_id", sessions.role().alias("role"))


# Sources and texts


_SUFFIX = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in parsers.SUFFIXES.items())
_REPO = r"github\.com[/:]([^/\s]+)/([^/\s#?]+?)(?:\.git)?(?:[/#?].*)?$"


@query(f"""WITH {_DOCS} SELECT id, CASE lower(regexp_extract(title, '\\.([^./\\\\]+)$', 1)) {_SUFFIX} END AS detected, CASE WHEN regexp_extract(source_url, '{_REPO}', 1) <> '' THEN regexp_extract(source_url, '{_REPO}', 1) || '/' || regexp_extract(source_url, '{_REPO}', 2) END AS repository FROM docs""")
def detected_types(spark: SparkSession, root: str) -> DataFrame:
    """The source type that each title's ending tells, and the repository that an address names."""
    return _docs(spark, root, "title", "source_url").select("id", parsers.detect_source_type(F.col("title")).alias("detected"), parsers.repository_name(F.col("source_url")).alias("repository"))


@query(f"""WITH {_DOCS}, l AS (SELECT id, unnest(string_split_regex(raw_text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line, generate_subscripts(string_split_regex(raw_text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), 1) AS n FROM docs WHERE length(raw_text) > 0),
  b AS (SELECT id, n, {_STRIP('line')} AS x FROM l), r AS (SELECT *, length(x) > 1 AND starts_with(x, '|') AND ends_with(x, '|') AS is_row FROM b),
  g AS (SELECT *, sum((NOT is_row)::INT) OVER (PARTITION BY id ORDER BY n) AS run, list_filter(list_transform(string_split(x, '|'), lambda c: {_STRIP('c')}), lambda c: c <> '') AS cells FROM r),
  t AS (SELECT id, run, count(*) AS rows FROM g WHERE is_row AND len(cells) > 0 AND len(list_filter(cells, lambda c: NOT regexp_full_match(c, '[-:]+'))) > 0 GROUP BY id, run HAVING count(*) > 1),
  c AS (SELECT id, count(*) AS tables, sum(rows)::BIGINT AS table_rows FROM t GROUP BY id)
  SELECT d.id, contains(raw_text, '![') AS has_images, contains(raw_text, '$') AS has_equations, c.id IS NOT NULL AS has_tables, coalesce(tables, 0)::BIGINT AS tables, coalesce(table_rows, 0)::BIGINT AS table_rows FROM docs d LEFT JOIN c ON c.id = d.id WHERE length(raw_text) > 0""")
def markdown_flags(spark: SparkSession, root: str) -> DataFrame:
    """What the text parser tells of each text read as Markdown."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [parsers.parse_text(t.encode("utf-8", "surrogatepass"), True) for t in pdf["raw_text"]]
            flags = {c: [r[c] for r in got] for c in ("has_images", "has_equations", "has_tables")}
            yield pd.DataFrame({"id": pdf["id"], **flags, "tables": [len(r["tables"]) for r in got], "table_rows": [sum(map(len, r["tables"])) for r in got]})

    return _docs(spark, root, "raw_text").where("length(raw_text) > 0").select("id", "raw_text").mapInPandas(read, "id string, has_images boolean, has_equations boolean, has_tables boolean, tables long, table_rows long")


@query(f"""WITH {_DOCS} SELECT id, regexp_matches(raw_text, '[{text.MATH_SYMBOLS}]') AS has_math, sha256(array_to_string(list_filter(list_transform(string_split(raw_text, chr(10) || chr(10)), lambda p: {_STRIP('p')}), lambda p: length(p) > 0), chr(10) || chr(10))) AS paragraphs,
    floor(length(raw_text) / 1000.0 + 0.5)::INT || 'k chars' AS label FROM docs WHERE raw_text IS NOT NULL""")
def text_properties(spark: SparkSession, root: str) -> DataFrame:
    """Whether a text has mathematics, its paragraphs set apart anew (as a hash), and the label of its size."""
    c = F.col("raw_text")
    return _docs(spark, root, "raw_text").where(c.isNotNull()).select("id", text.has_math(c).alias("has_math"), F.sha2(text.paragraphs(c), 256).alias("paragraphs"), text.kilo_chars(F.length(c)).alias("label"))


# Chunks


@query(r"""WITH ch AS (SELECT DISTINCT id, text FROM chunks) SELECT id, len(regexp_extract_all(text, '[\p{L}\p{N}_]{1,6}|[^\s\x0b\x1c-\x1f\x{85}\p{Z}\p{L}\p{N}_]'))::BIGINT AS tokens,
    len(list_filter(string_split_regex(text, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'), lambda w: w <> '')) < 15 AS is_short FROM ch WHERE text IS NOT NULL""")
def chunk_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The tokens of each chunk counted anew by the default counter, and whether it has too few words to be kept."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(chunking.approximate_tokens)

    return _chunks(spark, root, "text").where("text IS NOT NULL").select("id", count("text").alias("tokens"), (text.word_count("text") < chunking.MIN_WORDS).alias("is_short"))


@query(f"""WITH {_DOCS}, {_CHUNKS} SELECT c.id, c.doc_id, CASE WHEN length(c.text) > 0 THEN strpos(d.raw_text, right(c.text, 60)) ELSE 0 END::INT AS place FROM ch c JOIN docs d ON d.id = c.doc_id WHERE c.text IS NOT NULL AND d.raw_text IS NOT NULL""")
def chunk_places(spark: SparkSession, root: str) -> DataFrame:
    """Where each chunk's end is found in its document's text; 0 where it isn't."""
    chunks = _chunks(spark, root, "doc_id", "text")
    return chunking.places(chunks, _docs(spark, root, "raw_text"), 60)


_TITLE = "coalesce(title, '') || CASE WHEN summary IS NOT NULL AND summary <> '' AND summary <> 'No summary available.' THEN ' - ' || summary ELSE '' END"


@query(f"""WITH {_DOCS} SELECT id AS doc_id, CASE WHEN lower(trim(source_type)) = 'text' THEN 'recursive' ELSE 'markdown' END AS strategy, CASE WHEN length({_TITLE}) > 0 THEN '[Source: ' || {_TITLE} || ']' ELSE '' END AS header,
    true AS headed, true AS within_limit, true AS placed, true AS long_enough, true AS distinct_ids, lower(trim(source_type)) = 'text' AND length({_STRIP('raw_text')}) > 0 AS has_chunks FROM docs WHERE raw_text IS NOT NULL""")
def chunk_rules(spark: SparkSession, root: str) -> DataFrame:
    """What must hold for the chunks of every document cut anew, by its strategy: header, limit, offsets, length, ids.

    Large tables of Markdown may pass the limit. Only plain text with any words is sure to have chunks.
    """
    docs = _docs(spark, root, "project_id", "source_type", "title", "summary", "raw_text").where("raw_text IS NOT NULL")
    return chunking.rules(docs)


# Answers


_LATEX = lambda c: "".join(f"replace(" for _ in answers.LATEX) + c + "".join(f", '{k}', '{v}')" for k, v in answers.LATEX.items())


@query(f"""WITH {_MSGS}, l AS (SELECT id, string_split(content, chr(10)) AS ls FROM msgs WHERE content IS NOT NULL),
  n AS (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM l), f AS (SELECT *, starts_with(ltrim(line), '```') AS fence FROM n),
  s AS (SELECT *, sum(fence::INT) OVER (PARTITION BY id ORDER BY n) % 2 = 1 AS inside FROM f)
  SELECT id, count(*) FILTER (WHERE NOT fence AND NOT inside AND NOT starts_with(ltrim(line), '$$') AND regexp_matches(regexp_replace(line, '\\$[^$]+\\$', '', 'g'), '[{"".join(k for k in answers.MATH)}]')) AS math_lines, count(*) AS lines FROM s GROUP BY id""")
def math_lines(spark: SparkSession, root: str) -> DataFrame:
    """How many lines of each message have mathematics that is to be written in LaTeX, outside code and formulas."""
    rows = _messages(spark, root).where("content IS NOT NULL")
    before, after = F.split("content", "\n"), F.split(answers.math_to_latex()(F.col("content")), "\n")
    changed = F.size(F.filter(F.zip_with(before, after, lambda a, b: a != b), lambda x: x))
    return rows.select("id", changed.cast("long").alias("math_lines"), F.size(before).cast("long").alias("lines"))


# Streams


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM events GROUP BY ALL""")
def stream_daily(spark: SparkSession, root: str) -> DataFrame:
    """The events counted by day as a stream that reads what there is and stops."""
    schema = table(spark, root, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{root}/events.parquet*")
    return ingest.once(ingest.daily_activity(stream), "complete")
