"""Registry of the core's queries over a workspace folder, each with the SQL it is held against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, text
from ..functions.scores import overlap
from ..operators import activity, answering, chunking, corpus, embedding, fusion, keyword, semantic, sessions
from ..operators.rerank import lexical_logit, rerank
from ..tables import table
from . import chat
from . import search as searching

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The time that the activity queries look back from.
NOW = "2025-06-30 12:00:00"
#: Results of the ranked queries.
K = 10


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _docs(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """The latest row of each document with ``columns``; only they are read and moved."""
    return corpus.latest(table(spark, root, "project_documents", *dict.fromkeys(("id", "updated_at", *columns))), "id", "updated_at")


#: What a search tells of a document.
_ABOUT = ("title", "source_type", "source_url", "confidence_level")


def _chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """Each chunk once, with ``columns`` or all of them."""
    return table(spark, root, "chunks", *(dict.fromkeys(("id", *columns)) if columns else ())).dropDuplicates(["id"])


_INDEXED = ("project_id", "doc_id", "start_char", "text")


def _index(spark: SparkSession, root: str) -> keyword.Index:
    """The keyword index of all chunks, built once for each version of the table and read from disk then."""
    return keyword.cached(table(spark, root, "chunks", "id", *_INDEXED), keyword.version_of(spark, f"{root}/chunks.parquet"))


def _live_index(spark: SparkSession, root: str) -> keyword.Index:
    """The same of the chunks whose document exists."""
    docs = table(spark, root, "project_documents", F.col("id").alias("doc_id"))
    version = keyword.version_of(spark, f"{root}/chunks.parquet", f"{root}/project_documents.parquet")
    return keyword.cached(table(spark, root, "chunks", "id", *_INDEXED), version, docs=docs)


def _messages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "session_messages").dropDuplicates(["id"])


def _questions(spark: SparkSession, root: str) -> DataFrame:
    """(query_id, project_id, text): each different question of the users of a project, named by the least of its messages."""
    place = table(spark, root, "sessions", "id", "project_id").withColumnRenamed("id", "session_id")
    asked = _messages(spark, root).where((sessions.role() == "user") & (F.length("content") > 0)).join(place, "session_id")
    return asked.groupBy("project_id", F.col("content").alias("text")).agg(F.min("id").alias("query_id")).select("query_id", "project_id", "text")


# Shared parts of the SQL: rows delivered twice count once.
_DOCS = "docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) AS rn FROM project_documents) WHERE rn = 1)"
_CHUNKS = "ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM chunks) WHERE rn = 1)"
_MSGS = """msgs AS (SELECT * FROM (SELECT id, session_id, content, citations, created_at,
  CASE WHEN lower(trim(role)) IN ('user', 'system') THEN lower(trim(role)) WHEN role IS NOT NULL THEN 'assistant' END AS role,
  row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM session_messages) WHERE rn = 1)"""
_TURNS = _MSGS + ", turns AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) AS turn FROM msgs)"
_QUESTIONS = _MSGS + """, questions AS (SELECT min(m.id) AS query_id, s.project_id, m.content AS text FROM msgs m JOIN sessions s ON s.id = m.session_id
  WHERE m.role = 'user' AND length(m.content) > 0 GROUP BY s.project_id, m.content)"""
_W = r"'[\p{L}\p{N}_]+'"
_SP = r"[\s\x1c-\x1f\x{85}\p{Z}]"
_STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^{_SP}+', ''), '{_SP}+$', '')"
_NORM = lambda c: f"regexp_replace(regexp_replace(replace({_STRIP(c)}, chr(13) || chr(10), chr(10)), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
_BM25 = f"""words AS (SELECT project_id, id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), {_W}) AS ws FROM ch),
  sizes AS (SELECT project_id, chunk_id, len(ws) AS dl, ws FROM words),
  projs AS (SELECT project_id, count(*) AS n, avg(dl) AS avgdl FROM sizes GROUP BY project_id),
  posts AS (SELECT project_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT project_id, chunk_id, dl, unnest(ws) AS term FROM sizes) GROUP BY ALL),
  dfs AS (SELECT project_id, term, count(*) AS df FROM posts GROUP BY project_id, term),
  raws AS (SELECT d.*, p.n, p.avgdl, ln(p.n - d.df + 0.5) - ln(d.df + 0.5) AS raw FROM dfs d JOIN projs p USING (project_id)),
  means AS (SELECT project_id, avg(raw) AS mean_idf FROM raws GROUP BY project_id),
  terms AS (SELECT r.project_id, term, df, avgdl, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raws r JOIN means m ON m.project_id = r.project_id),
  asked AS (SELECT query_id, project_id, term, count(*) AS qf FROM (SELECT query_id, project_id, unnest(regexp_extract_all(lower(text), {_W})) AS term FROM questions) GROUP BY ALL),
  scored AS (SELECT a.query_id, p.chunk_id, round(sum(a.qf * t.idf * p.tf * 2.5 / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / t.avgdl))), 6) AS score, count(*) AS matched
    FROM asked a JOIN terms t ON t.project_id = a.project_id AND t.term = a.term JOIN posts p ON p.project_id = a.project_id AND p.term = a.term GROUP BY a.query_id, p.chunk_id),
  top AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c.doc_id, c.start_char, s.chunk_id) AS rank
    FROM scored s JOIN ch c ON c.id = s.chunk_id) WHERE rank <= {K})"""


# Retrieval


@query(f"""WITH {_QUESTIONS}, {_CHUNKS}, {_BM25}
  SELECT query_id, chunk_id, score, round(score / CASE WHEN m > 0 THEN m ELSE 1.0 END, 6) AS normalized, rank
  FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM top) WHERE score > 0""")
def keyword_topk(spark: SparkSession, root: str) -> DataFrame:
    return keyword.search(_index(spark, root), _questions(spark, root), K).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {_QUESTIONS}, {_CHUNKS}, {_BM25}
  SELECT p.project_id, p.n AS chunks, round(p.avgdl, 6) AS avgdl, count(*) AS terms, round(m.mean_idf, 6) AS mean_idf, count(*) FILTER (WHERE r.raw < 0) AS common_terms
  FROM projs p JOIN means m ON m.project_id = p.project_id JOIN raws r ON r.project_id = p.project_id GROUP BY ALL""")
def bm25_stats(spark: SparkSession, root: str) -> DataFrame:
    index = _index(spark, root)
    common = index.terms.join(index.projects.select("project_id", "n"), "project_id").where(2 * F.col("df") > F.col("n"))
    counts = index.terms.groupBy("project_id").agg(F.count(F.lit(1)).alias("terms"))
    rows = index.projects.join(counts, "project_id").join(common.groupBy("project_id").agg(F.count(F.lit(1)).alias("common_terms")), "project_id", "left")
    return rows.select("project_id", F.col("n").alias("chunks"), F.round("avgdl", 6).alias("avgdl"), "terms", F.round("mean_idf", 6).alias("mean_idf"), F.coalesce("common_terms", F.lit(0)).alias("common_terms"))


_VECTORS = f"""{_CHUNKS}, good AS (SELECT * FROM chunk_embeddings WHERE vector IS NOT NULL AND len(vector) = dimension AND len(vector) > 0
    AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
  vecs AS (SELECT g.chunk_id, c.project_id, g.model_name, g.vector::DOUBLE[] AS v FROM
    (SELECT *, row_number() OVER (PARTITION BY chunk_id, model_name ORDER BY created_at DESC, id DESC) AS r FROM good) g JOIN ch c ON c.id = g.chunk_id WHERE r = 1)"""


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return semantic.live_vectors(table(spark, root, "chunk_embeddings"), table(spark, root, "chunks", "id", "project_id"))


@query(f"""WITH {_VECTORS}, q AS (SELECT chunk_id || '/' || model_name AS query_id, * FROM vecs WHERE ('0x' || substr(chunk_id, 5, 8))::BIGINT % 20 = 0),
  s AS (SELECT q.query_id, x.chunk_id, round((1 + list_cosine_similarity(q.v, x.v)) / 2, 6) AS score FROM q JOIN vecs x ON x.project_id = q.project_id AND x.model_name = q.model_name)
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) WHERE rank <= {K}""")
def semantic_topk(spark: SparkSession, root: str) -> DataFrame:
    """The stated query set, every 20th chunk by its id, against all vectors of its project."""
    vectors = _vectors(spark, root)
    asked = vectors.where(F.conv(F.substring("chunk_id", 5, 8), 16, 10).cast("long") % 20 == 0).withColumn("query_id", F.concat_ws("/", "chunk_id", "model_name"))
    return semantic.search(vectors, asked.drop("chunk_id"), K).select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {_QUESTIONS}, {_CHUNKS}, {_BM25},
  cov AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, chunk_id) AS rank, score FROM scored) WHERE rank <= {K} AND score > 0),
  bag AS (SELECT query_id, chunk_id, rank, 0 AS o FROM top WHERE score > 0 UNION ALL SELECT query_id, chunk_id, rank, 1 FROM cov),
  fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused, min(CASE WHEN o = 0 THEN rank END) AS r0, min(CASE WHEN o = 1 THEN rank END) AS r1 FROM bag GROUP BY ALL)
  SELECT query_id, chunk_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, r0 ASC NULLS LAST, r1 ASC NULLS LAST, chunk_id) AS rank FROM fused""")
def rrf_fusion(spark: SparkSession, root: str) -> DataFrame:
    """BM25 fused with a list by the number of the question's words that match."""
    index, asked = _index(spark, root), _questions(spark, root)
    return fusion.fuse(keyword.search(index, asked, K), keyword.search(index, asked, K, order="matched")).withColumn("rank", F.col("rank").cast("long"))


#: The model whose stored vectors are searched, and what embeds questions in its place.
MODEL = embedding.HashedWords(64, "local-mini-64")


def _stored(spark: SparkSession, root: str) -> dict:
    """The stored vectors of the model, of chunks whose document exists, and the embedder for questions."""
    docs = table(spark, root, "project_documents", "id").select(F.col("id").alias("doc_id")).distinct()
    places = _chunks(spark, root, "doc_id", "project_id").join(docs, "doc_id", "left_semi")
    stored = table(spark, root, "chunk_embeddings").where(F.col("model_name") == MODEL.name)
    return {"vectors": semantic.live_vectors(stored, places), "embedder": MODEL}


@query()
def hybrid_search(spark: SparkSession, root: str) -> DataFrame:
    return searching.search(_questions(spark, root), table(spark, root, "chunks"), _docs(spark, root, *_ABOUT), mode="hybrid", index=_live_index(spark, root), **_stored(spark, root))


@query()
def keyword_search(spark: SparkSession, root: str) -> DataFrame:
    return searching.search(_questions(spark, root), table(spark, root, "chunks"), _docs(spark, root, *_ABOUT), mode="keyword", index=_live_index(spark, root))


@query()
def semantic_search(spark: SparkSession, root: str) -> DataFrame:
    return searching.search(_questions(spark, root), table(spark, root, "chunks"), _docs(spark, root, *_ABOUT), mode="semantic", **_stored(spark, root))


@query()
def context_windows(spark: SparkSession, root: str) -> DataFrame:
    asked = _questions(spark, root)
    return answering.context_windows(asked, searching.search(asked, table(spark, root, "chunks"), _docs(spark, root, *_ABOUT), mode="keyword", index=_live_index(spark, root), top_k=5))


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_KEYS = lambda c: f"list_filter(list_filter(regexp_extract_all(lower({c}), {_W}), lambda w: regexp_full_match(w, '[a-z]{{3,}}')), lambda w: NOT list_contains([{_STOPS}], w))"


@query(f"""WITH {_QUESTIONS}, {_CHUNKS}, {_BM25},
  pairs AS (SELECT t.query_id, t.chunk_id, t.rank, {_KEYS('q.text')} AS keys, regexp_extract_all(lower(q.text), {_W}) AS ws, regexp_extract_all(lower(c.text), {_W}) AS cw
    FROM top t JOIN questions q USING (query_id) JOIN ch c ON c.id = t.chunk_id WHERE t.score > 0),
  asks AS (SELECT *, list_distinct(CASE WHEN len(keys) > 0 THEN keys ELSE ws END) AS a FROM pairs),
  hits AS (SELECT *, len(list_filter(a, lambda w: list_contains(cw, w))) AS h FROM asks),
  scores AS (SELECT query_id, chunk_id, rank, round(1 / (1 + exp(3.0 - 6.0 * (CASE WHEN len(a) > 0 THEN h::DOUBLE / len(a) ELSE 0.0 END))), 6) AS rerank_score FROM hits)
  SELECT query_id, chunk_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank, chunk_id) AS rank FROM scores""")
def reranked(spark: SparkSession, root: str) -> DataFrame:
    chunks, asked = _chunks(spark, root, "text"), _questions(spark, root)
    found = keyword.search(_index(spark, root), asked, K)
    pairs = found.join(asked.select("query_id", F.col("text").alias("query")), "query_id").join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")
    return rerank(pairs, lexical_logit).select("query_id", "chunk_id", "rerank_score", F.col("rank").cast("long").alias("rank"))


# Documents


@query(f"""WITH {_DOCS}, h AS (SELECT id, project_id, created_at, CASE WHEN length({_NORM('raw_text')}) > 0 THEN sha256({_NORM('raw_text')}) END AS content_hash FROM docs)
  SELECT id, project_id, content_hash, coalesce(first_id <> id, false) AS is_duplicate, first_id FROM
    (SELECT *, CASE WHEN content_hash IS NOT NULL THEN first_value(id) OVER (PARTITION BY project_id, content_hash ORDER BY created_at, id) END AS first_id FROM h)""")
def content_hash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return corpus.flag_duplicates(_docs(spark, root, "project_id", "created_at", "raw_text").select("id", "project_id", "created_at", "raw_text"))


@query(f"""WITH {_DOCS} SELECT id, project_id, lower(trim(source_type)) AS source_type, title, coalesce(length(raw_text), 0) AS char_count, confidence_level,
    coalesce(processing_status, 'ready') AS processing_status, coalesce(processing_status, 'ready') = 'duplicate' AS is_duplicate, summary FROM docs""")
def doc_summaries(spark: SparkSession, root: str) -> DataFrame:
    return corpus.summaries(_docs(spark, root, "project_id", "source_type", "title", "raw_text", "confidence_level", "processing_status", "summary", "created_at")).drop("created_at")


@query(f"""WITH {_DOCS} SELECT id, title, raw_text, coalesce(metadata['page_count'], '') AS page_count, coalesce(metadata['repo_name'], '') AS repo_name, coalesce(cardinality(metadata), 0)::BIGINT AS metadata_keys,
    CASE WHEN lower(trim(source_type)) IN ('pdf', 'docx', 'pptx', 'markdown', 'text') THEN 3 WHEN lower(trim(source_type)) IN ('web', 'repository') THEN 2 END AS confidence FROM docs""")
def doc_detail(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root, "title", "raw_text", "metadata", "source_type")
    key = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(k)
    return docs.select("id", "title", "raw_text", key("page_count"), key("repo_name"), F.coalesce(F.when(F.col("metadata").isNotNull(), F.size("metadata")), F.lit(0)).cast("long").alias("metadata_keys"), corpus.confidence(F.col("source_type")).alias("confidence"))


@query(f"""WITH {_DOCS} SELECT d.id, d.title, p.name AS project_name, strftime(d.created_at AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at
  FROM docs d JOIN projects p ON p.id = d.project_id""")
def global_documents(spark: SparkSession, root: str) -> DataFrame:
    joined = corpus.with_project(_docs(spark, root, "title", "project_id", "created_at"), table(spark, root, "projects", "id", "name"))
    return joined.orderBy(F.desc("created_at"), "id").select("id", "title", "project_name", _stamp("created_at"))


@query(f"""WITH {_DOCS} SELECT p.id, p.name, count(d.id) AS documents FROM projects p LEFT JOIN docs d ON d.project_id = p.id GROUP BY p.id, p.name""")
def project_counts(spark: SparkSession, root: str) -> DataFrame:
    return activity.project_counts(table(spark, root, "projects"), table(spark, root, "project_documents", "id", "project_id")).drop("updated_at")


@query(f"""WITH {_DOCS}, t AS (SELECT id, coalesce(title, '') AS t, coalesce(source_url, '') AS u, lower(trim(source_type)) AS k, processing_status, source_url, title FROM docs),
  e AS (SELECT *, CASE WHEN k = 'web' AND (contains(lower(t), 'github') OR contains(lower(u), 'github')) THEN 'repository' ELSE k END AS effective_type FROM t)
  SELECT id, effective_type, CASE lower(trim(processing_status)) WHEN 'parsing' THEN 'Parsing' WHEN 'chunking' THEN 'Chunking' WHEN 'embedding' THEN 'Embedding' WHEN 'ready' THEN 'Ready'
      WHEN 'failed' THEN 'Failed' WHEN 'duplicate' THEN 'Duplicate' WHEN 'pending' THEN 'Pending' ELSE 'In Queue' END AS status_label,
    CASE WHEN regexp_matches(lower(t), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(t), '\\.(docx|doc)$') THEN 'word' WHEN regexp_matches(lower(t), '\\.(pptx|ppt)$') THEN 'slides' WHEN regexp_matches(lower(t), '\\.(md|txt)$') THEN 'text'
      WHEN effective_type = 'repository' THEN 'repository' WHEN k = 'pdf' THEN 'pdf' WHEN k = 'docx' THEN 'word' WHEN k = 'pptx' THEN 'slides' WHEN k IN ('markdown', 'text') THEN 'text' ELSE 'web' END AS icon,
    regexp_replace(source_url, '^(https?://)?(www\\.)?', '') AS bare_url, regexp_replace(regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS host FROM e""")
def document_labels(spark: SparkSession, root: str) -> DataFrame:
    c = F.col
    return _docs(spark, root, "source_type", "title", "source_url", "processing_status").select(
        "id",
        corpus.effective_type(c("source_type"), c("title"), c("source_url")).alias("effective_type"),
        corpus.status_label(c("processing_status")).alias("status_label"),
        corpus.icon(c("title"), c("source_type"), c("source_url")).alias("icon"),
        corpus.bare_url(c("source_url")).alias("bare_url"),
        corpus.host(c("source_url")).alias("host"),
    )


@query(f"""WITH {_DOCS} SELECT d.id, d.title, p.name AS project_name FROM docs d JOIN projects p ON p.id = d.project_id
  WHERE coalesce(contains(lower(d.title), 'report'), false) OR coalesce(contains(lower(p.name), 'report'), false) OR coalesce(contains(lower(d.summary), 'report'), false)""")
def discovery_search(spark: SparkSession, root: str) -> DataFrame:
    joined = corpus.with_project(_docs(spark, root, "title", "project_id", "summary"), table(spark, root, "projects", "id", "name"))
    return corpus.find(joined, "Report", "title", "project_name", "summary").select("id", "title", "project_name")


_RECENT = "SELECT id FROM docs ORDER BY created_at DESC, id LIMIT 3"


@query(f"WITH {_DOCS} {_RECENT}")
def recent3(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root, "created_at").orderBy(F.desc("created_at"), "id").limit(3).select("id")


@query(f"WITH {_DOCS} SELECT id, title FROM docs WHERE id NOT IN ({_RECENT})")
def rest_antijoin(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root, "title").select("id", "title").join(recent3(spark, root), "id", "left_anti")


@query("SELECT id FROM projects ORDER BY updated_at DESC, id LIMIT 8")
def recent_projects(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "projects", "id", "updated_at").orderBy(F.desc("updated_at"), "id").limit(8).select("id")


@query(f"""WITH {_DOCS}, {_CHUNKS} SELECT DISTINCT e.id FROM chunk_embeddings e WHERE e.chunk_id IN (SELECT c.id FROM ch c WHERE c.doc_id IN (SELECT id FROM docs WHERE confidence_level = 3))""")
def embeddings_of_docs(spark: SparkSession, root: str) -> DataFrame:
    docs = _docs(spark, root, "confidence_level").where("confidence_level = 3").select("id")
    return embedding.of_documents(table(spark, root, "chunk_embeddings", "id", "chunk_id"), _chunks(spark, root, "doc_id"), docs).select("id").distinct()


@query(f"""WITH {_DOCS}, s AS (SELECT id, {_STRIP("replace(summary, chr(10), ' ')")} AS t FROM docs), n AS (SELECT id, {_NORM('raw_text')} AS t FROM docs)
  SELECT s.id, CASE WHEN length(s.t) > 200 THEN substr(s.t, 1, 197) || '...' ELSE s.t END AS summary, length(n.t) AS normal_chars FROM s JOIN n ON n.id = s.id""")
def clean_summaries(spark: SparkSession, root: str) -> DataFrame:
    return _docs(spark, root, "summary", "raw_text").select("id", text.clean_summary("summary").alias("summary"), F.length(text.normalize_text("raw_text")).cast("long").alias("normal_chars"))


_CUTOFF = "CASE WHEN starts_with(text, '[Source:') AND strpos(text, ']' || chr(10)) > 0 THEN regexp_replace(substr(text, strpos(text, ']' || chr(10)) + 2), '^" + _SP + "+', '') WHEN starts_with(text, '[Source:') AND strpos(text, chr(10)) > 0 THEN regexp_replace(substr(text, strpos(text, chr(10)) + 1), '^" + _SP + "+', '') ELSE text END"


@query(f"""WITH {_CHUNKS}, s AS (SELECT id, {_STRIP('(' + _CUTOFF + ')')} AS t FROM ch), h AS (SELECT id, t, substr(t, 1, 1500) AS head FROM s),
  p AS (SELECT *, CASE WHEN strpos(head, '.') > 0 THEN length(head) - strpos(reverse(head), '.') + 1 ELSE 0 END AS stop FROM h)
  SELECT id, CASE WHEN length(t) > 1500 THEN CASE WHEN stop - 1 > 750 THEN substr(head, 1, stop) ELSE head || '...' END ELSE t END AS text FROM p""")
def strip_prefix_truncate(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root, "text").select("id", text.truncate_to_sentence(text.strip(text.strip_context_prefix("text"))).alias("text"))


@query(f"""WITH {_CHUNKS}, w AS (SELECT id, doc_id, list_distinct(regexp_extract_all(lower(text), {_W})) AS ws, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, id) AS n FROM ch),
  p AS (SELECT a.id, b.id AS previous, a.ws AS x, b.ws AS y FROM w a JOIN w b ON b.doc_id = a.doc_id AND b.n = a.n - 1)
  SELECT id, previous, round(len(list_filter(x, lambda t: list_contains(y, t)))::DOUBLE / least(len(x), len(y)), 6) AS overlap FROM p WHERE len(x) > 0 AND len(y) > 0""")
def neighbour_overlap(spark: SparkSession, root: str) -> DataFrame:
    """The overlap coefficient of each chunk's words with those of the chunk before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start_char", "id")
    rows = _chunks(spark, root, "doc_id", "start_char", "text").select("id", "doc_id", "start_char", F.array_distinct(text.tokens("text")).alias("x"))
    rows = rows.withColumn("before", F.lag(F.struct("id", "x")).over(w)).where(F.col("before").isNotNull() & (F.size("x") > 0) & (F.size("before.x") > 0))
    return rows.select("id", F.col("before.id").alias("previous"), F.round(overlap(F.col("x"), F.col("before.x")), 6).alias("overlap"))


@query(f"""WITH {_CHUNKS} SELECT c.id, c.doc_id, c.start_char, c.end_char, c.strategy, coalesce(c.metadata['breadcrumbs'], '') AS breadcrumbs FROM ch c JOIN (SELECT DISTINCT id FROM project_documents) d ON d.id = c.doc_id""")
def chunk_listing(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "project_documents", "id").select(F.col("id").alias("doc_id"))
    rows = _chunks(spark, root, "doc_id", "start_char", "end_char", "strategy", "metadata").join(docs, "doc_id", "left_semi")
    return rows.orderBy("doc_id", "start_char", "id").select("id", "doc_id", "start_char", "end_char", "strategy", F.coalesce(F.try_element_at("metadata", F.lit("breadcrumbs")), F.lit("")).alias("breadcrumbs"))


@query(f"""WITH {_CHUNKS} SELECT strategy, count(*) AS chunks, round(avg(token_count), 6) AS avg_tokens, count(*) FILTER (WHERE token_count > 500) AS oversized FROM ch GROUP BY strategy""")
def chunk_quality(spark: SparkSession, root: str) -> DataFrame:
    return _chunks(spark, root, "strategy", "token_count").groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("token_count"), 6).alias("avg_tokens"), F.count_if(F.col("token_count") > 500).alias("oversized"))


@query(f"""WITH {_DOCS} SELECT processing_status, count(*) AS documents, count(*) FILTER (WHERE summary IS NULL OR summary = 'No summary available.') AS without_summary FROM docs GROUP BY processing_status""")
def status_counts(spark: SparkSession, root: str) -> DataFrame:
    bare = F.col("summary").isNull() | (F.col("summary") == "No summary available.")
    return _docs(spark, root, "processing_status", "summary").groupBy("processing_status").agg(F.count(F.lit(1)).alias("documents"), F.count_if(bare).alias("without_summary"))


@query()
def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    """All documents chunked anew, Markdown by headings and plain text by size."""
    return chunking.chunk_documents(_docs(spark, root, "project_id", "source_type", "title", "summary", "raw_text")).select("id", "doc_id", "text", "start_char", "end_char", "token_count", "strategy", F.to_json("metadata").alias("metadata"))


@query(f"""WITH {_CHUNKS}, held AS (SELECT chunk_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC, id DESC) AS r FROM chunk_embeddings WHERE model_name = 'local-mini-64') WHERE r = 1)
  SELECT c.id AS chunk_id, sha256(c.text) AS content_hash, coalesce(h.content_hash = sha256(c.text), false) AS is_cached FROM ch c LEFT JOIN held h ON h.chunk_id = c.id WHERE c.text IS NOT NULL""")
def embed_plan(spark: SparkSession, root: str) -> DataFrame:
    """Which chunks have a vector for their present text, and which must be embedded."""
    return embedding.plan(_chunks(spark, root, "text"), table(spark, root, "chunk_embeddings"), "local-mini-64")


@query(f"""WITH {_CHUNKS} SELECT substr(sha256(id || '/hashed-words-384'), 1, 12) AS id, id AS chunk_id, 'hashed-words-384' AS model_name, 384 AS dimension, sha256(text) AS content_hash, 384 AS size,
    CASE WHEN regexp_matches(text, {_W}) THEN 1.0 ELSE 0.0 END AS length, false AS is_cached FROM ch WHERE text IS NOT NULL""")
def embed_incremental(spark: SparkSession, root: str) -> DataFrame:
    rows = embedding.embed_changed(_chunks(spark, root, "text"), table(spark, root, "chunk_embeddings"), embedding.provider("hashed-words-384"), _now())
    length = F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3)
    return rows.select("id", "chunk_id", "model_name", "dimension", "content_hash", F.size("vector").alias("size"), length.alias("length"), "is_cached")


@query(f"""WITH {_DOCS}, {_CHUNKS}, gone AS (SELECT id FROM projects WHERE last_indexed_at IS NULL), m AS ({_MSGS.split('AS (', 1)[1].rsplit(')', 1)[0]})
  SELECT 'projects' AS name, id FROM projects WHERE id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'project_documents', id FROM docs WHERE project_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'chunks', id FROM ch WHERE project_id NOT IN (SELECT id FROM gone) AND doc_id NOT IN (SELECT id FROM docs WHERE project_id IN (SELECT id FROM gone))
  UNION ALL SELECT 'sessions', id FROM sessions WHERE project_id NOT IN (SELECT id FROM gone)
  UNION ALL SELECT 'session_messages', id FROM m WHERE session_id NOT IN (SELECT id FROM sessions WHERE project_id IN (SELECT id FROM gone))""")
def cascade_delete(spark: SparkSession, root: str) -> DataFrame:
    """The ids that stay of each table when the projects that were never indexed are deleted with all that hangs on them."""
    from functools import reduce

    messages = table(spark, root, "session_messages", "id", "session_id").dropDuplicates(["id"])
    tables = {"projects": table(spark, root, "projects"), "project_documents": _docs(spark, root, "project_id"), "chunks": _chunks(spark, root, "doc_id", "project_id"), "sessions": table(spark, root, "sessions"), "session_messages": messages}
    left = corpus.delete(tables, "projects", tables["projects"].where("last_indexed_at IS NULL").select("id"))
    return reduce(lambda a, b: a.unionByName(b), [df.select(F.lit(name).alias("name"), "id") for name, df in left.items()])


@query("""SELECT chunk_id, model_name, id FROM (SELECT id, chunk_id, model_name, row_number() OVER (PARTITION BY chunk_id, model_name ORDER BY created_at DESC, id DESC) AS r FROM chunk_embeddings) WHERE r = 1""")
def vector_upsert(spark: SparkSession, root: str) -> DataFrame:
    """The vector store after all rows were upserted one after the other: which row is left of each chunk and model."""
    rows = table(spark, root, "chunk_embeddings", "id", "chunk_id", "model_name", "created_at")
    return semantic.merged(rows.limit(0), rows).select("chunk_id", "model_name", "id")


# Sessions


@query(f"""WITH {_TURNS}, h AS (SELECT *, list(coalesce(content, '')) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS hist FROM turns),
  k AS (SELECT id, content, {_KEYS("lower(content)")} AS qk, {_STRIP('lower(content)')} AS q, list_slice(list_distinct_ordered, 1, 6) AS terms FROM
    (SELECT *, list_filter(ks, lambda x, i: list_position(ks, x) = i) AS list_distinct_ordered FROM (SELECT *, {_KEYS("coalesce(array_to_string(hist, ' '), '')")} AS ks FROM h WHERE role = 'user')))
  SELECT id, CASE WHEN (len(qk) <= 2 OR {' OR '.join(f"starts_with(q, '{s}')" for s in text.REFERENTIAL)}) AND len(terms) > 0 THEN '[' || array_to_string(terms, ' ') || '] ' || content ELSE content END AS search_query FROM k""")
def query_rewrite(spark: SparkSession, root: str) -> DataFrame:
    return sessions.rewritten(sessions.ordered(_messages(spark, root))).select("id", "search_query")


@query(f"""WITH {_TURNS}, h AS (SELECT *, list(role || ': ' || coalesce(content, '')) OVER w AS hist FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
  t AS (SELECT id, CASE WHEN len(hist) > 0 AND NOT starts_with(hist[1], 'user: ') THEN list_slice(hist, 2, 6) ELSE hist END AS hist FROM h)
  SELECT id, coalesce(len(hist), 0) AS messages, coalesce(array_to_string(hist, chr(10)), '') AS history FROM t""")
def chat_history_window(spark: SparkSession, root: str) -> DataFrame:
    seen = sessions.with_history(sessions.ordered(_messages(spark, root)))
    lines = F.transform("history", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), m["content"]))
    return seen.select("id", F.size("history").cast("long").alias("messages"), F.array_join(lines, "\n").alias("history"))


@query(f"""WITH {_TURNS}, n AS (SELECT *, lead(id) OVER w AS nid, lead(role) OVER w AS nrole, lag(id) OVER w AS lid, lag(role) OVER w AS lrole FROM turns WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
  hit AS (SELECT * FROM n WHERE role = 'user' AND length(content) < 20),
  gone AS (SELECT id FROM hit UNION SELECT nid FROM hit WHERE nrole = 'assistant')
  SELECT id, session_id, role FROM turns WHERE id NOT IN (SELECT id FROM gone)""")
def message_pair_delete(spark: SparkSession, root: str) -> DataFrame:
    """The messages without the short questions and their answers."""
    messages = _messages(spark, root)
    short = messages.where((sessions.role() == "user") & (F.length("content") < 20)).select("id")
    return sessions.without_pairs(messages, short).select("id", "session_id", sessions.role().alias("role"))


@query(f"""WITH {_MSGS} SELECT s.id, s.project_id, s.title, strftime(coalesce(s.updated_at, s.created_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last_used, count(m.id) AS messages
  FROM sessions s LEFT JOIN msgs m ON m.session_id = s.id GROUP BY ALL""")
def sessions_listing(spark: SparkSession, root: str) -> DataFrame:
    return sessions.listing(table(spark, root, "sessions"), _messages(spark, root)).withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_TURNS} SELECT s.id, count(t.id) AS messages, coalesce(string_agg(t.id, ',' ORDER BY t.turn), '') AS ids FROM sessions s LEFT JOIN turns t ON t.session_id = s.id GROUP BY s.id""")
def sessions_nested(spark: SparkSession, root: str) -> DataFrame:
    rows = sessions.nested(table(spark, root, "sessions"), _messages(spark, root))
    ids = F.coalesce(F.array_join(F.transform("messages", lambda m: m["id"]), ","), F.lit(""))
    return rows.select("id", F.coalesce(F.when(F.col("messages").isNotNull(), F.size("messages")), F.lit(0)).cast("long").alias("messages"), ids.alias("ids"))


@query(f"""WITH {_TURNS}, f AS (SELECT session_id, content, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS r FROM turns WHERE role = 'user')
  SELECT session_id, CASE WHEN length(content) > 50 THEN substr(content, 1, 50) || '...' ELSE content END AS title FROM f JOIN sessions s ON s.id = f.session_id WHERE r = 1""")
def auto_titles(spark: SparkSession, root: str) -> DataFrame:
    return chat.titles(_messages(spark, root), table(spark, root, "sessions"))


@query(f"""WITH {_MSGS}, a AS (SELECT id, content, coalesce(len(citations), 0) AS n FROM msgs WHERE role = 'assistant'),
  c AS (SELECT id, n, content, list_sort(list_distinct(list_transform(regexp_extract_all(content, '\\[(?:[Ss][Oo][Uu][Rr][Cc][Ee]\\s*)?(\\d+)\\]', 1), lambda x: x::INT))) AS cited FROM a)
  SELECT id, array_to_string(cited, ',') AS cited, array_to_string(list_filter(cited, lambda x: x >= 1 AND x <= n), ',') AS used,
    {' OR '.join(f"contains(lower(content), '{p.replace(chr(39), chr(39) * 2)}')" for p in answers.REFUSALS)} AS refusal FROM c""")
def answer_citations(spark: SparkSession, root: str) -> DataFrame:
    rows = _messages(spark, root).where(sessions.role() == "assistant").withColumn("n", F.coalesce(F.when(F.col("citations").isNotNull(), F.size("citations")), F.lit(0)))
    c = F.col("content")
    return rows.select("id", F.array_join(answers.cited(c), ",").alias("cited"), F.array_join(answers.used_sources(c, F.col("n")), ",").alias("used"), answers.is_refusal(c).alias("refusal"))


@query()
def answers_grounded(spark: SparkSession, root: str) -> DataFrame:
    """The stored answers cleaned, with their citations renumbered and what they use."""
    rows = _messages(spark, root).where(sessions.role() == "assistant").withColumn("n_sources", F.coalesce(F.when(F.col("citations").isNotNull(), F.size("citations")), F.lit(0)))
    out = answering.grounded(rows.select("id", F.coalesce("content", F.lit("")).alias("answer"), "n_sources"))
    return out.select("id", "answer", F.array_join("used", ",").alias("used"), "sufficient", answers.link_citations(F.col("answer")).alias("linked"))


@query(f"""WITH {_MSGS}, r AS (SELECT id AS message_id, unnest(citations) AS c, generate_subscripts(citations, 1) AS n FROM msgs WHERE len(citations) > 0)
  SELECT message_id, c.doc_id AS doc_id, arg_min(c.doc_title, n) AS doc_title, string_agg(n::VARCHAR, ',' ORDER BY n) AS numbers, min(n)::BIGINT AS first_number FROM r GROUP BY message_id, c.doc_id""")
def citations_by_document(spark: SparkSession, root: str) -> DataFrame:
    rows = sessions.citation_groups(_messages(spark, root))
    return rows.select("message_id", "doc_id", "doc_title", F.array_join("numbers", ",").alias("numbers"), F.col("first_number").cast("long").alias("first_number"))


@query()
def chat_replay(spark: SparkSession, root: str) -> DataFrame:
    """Every question of every session answered again from its project's chunks."""
    rows = chat.replay(_messages(spark, root), table(spark, root, "sessions"), table(spark, root, "chunks"), _docs(spark, root, *_ABOUT), index=_live_index(spark, root))
    return rows.select("query_id", "session_id", "turn", F.size("prompt").alias("prompt_messages"), "answer", F.array_join("used", ",").alias("used"), "sufficient", F.size("citations").alias("citations"))


# Activity


@query(f"""WITH {_DOCS}, {_CHUNKS}, {_MSGS} SELECT (SELECT count(*) FROM projects) AS total_projects, (SELECT count(*) FROM docs) AS total_documents, (SELECT count(*) FROM sessions) AS total_sessions,
    (SELECT count(*) FROM msgs) AS total_messages, (SELECT coalesce(sum(token_count), 0)::BIGINT FROM ch) AS total_tokens_ingested""")
def activity_metrics(spark: SparkSession, root: str) -> DataFrame:
    t = lambda n, *c: table(spark, root, n, *c)
    return activity.metrics(t("projects", "id"), t("project_documents", "id"), t("sessions", "id"), t("session_messages", "id"), t("chunks", "id", "token_count"))


_NOW = f"TIMESTAMP '{NOW}'"
_AT = "(created_at AT TIME ZONE 'UTC')"
_SERIES = f"""{_DOCS}, {_MSGS}, grid AS (SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(DATE '{NOW[:10]}' - INTERVAL 29 DAY, DATE '{NOW[:10]}'::TIMESTAMP, INTERVAL 1 DAY)) AS d)),
  dd AS (SELECT strftime({_AT}, '%Y-%m-%d') AS date, count(*) AS n FROM docs WHERE {_AT} >= {_NOW} - INTERVAL 30 DAY GROUP BY 1), mm AS (SELECT strftime({_AT}, '%Y-%m-%d') AS date, count(*) AS n FROM msgs WHERE {_AT} >= {_NOW} - INTERVAL 30 DAY GROUP BY 1),
  series AS (SELECT g.date, coalesce(dd.n, 0) AS documents, coalesce(mm.n, 0) AS messages FROM grid g LEFT JOIN dd ON dd.date = g.date LEFT JOIN mm ON mm.date = g.date)"""


@query(f"WITH {_SERIES} SELECT * FROM series")
def activity_timeline(spark: SparkSession, root: str) -> DataFrame:
    return activity.timeline(_docs(spark, root, "created_at").select("id", "created_at"), _messages(spark, root), _now())


@query(f"WITH {_SERIES} SELECT date, documents, sum(documents) OVER (ORDER BY date)::BIGINT AS total FROM series")
def activity_cumulative(spark: SparkSession, root: str) -> DataFrame:
    return activity.cumulative(activity_timeline(spark, root))


@query(f"WITH {_SERIES} SELECT * FROM series ORDER BY date DESC LIMIT 14")
def activity_last14(spark: SparkSession, root: str) -> DataFrame:
    return activity.last_rows(activity_timeline(spark, root), 14)


@query(f"""WITH {_DOCS}, c AS (SELECT lower(trim(source_type)) AS source_type, count(*) AS documents FROM docs WHERE {_AT} >= {_NOW} - INTERVAL 30 DAY GROUP BY 1)
  SELECT source_type, documents, round(documents::DOUBLE / sum(documents) OVER (), 6) AS share FROM c""")
def source_type_counts(spark: SparkSession, root: str) -> DataFrame:
    return activity.type_counts(_docs(spark, root, "source_type", "created_at"), _now())


@query(f"""WITH {_DOCS}, c AS (SELECT project_id, count(*) AS documents FROM docs WHERE {_AT} >= {_NOW} - INTERVAL 30 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
  SELECT c.project_id, coalesce(p.name, 'Unknown') AS name, documents FROM c LEFT JOIN projects p ON p.id = c.project_id""")
def top5_projects(spark: SparkSession, root: str) -> DataFrame:
    return activity.top_projects(_docs(spark, root, "project_id", "created_at"), table(spark, root, "projects"), _now())


# General patterns on the larger tables


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY ALL""")
def events_daily(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events", "ts", "event_type", "value").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


@query("""SELECT c.c_custkey, count(o.o_orderkey) AS orders, round(coalesce(sum(o.o_totalprice), 0), 2) AS spent FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def customer_orders(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_totalprice").alias("spent"))
    joined = table(spark, root, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def customers_without_orders(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders", "o_custkey")
    return table(spark, root, "customer", "c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS lines, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount
  FROM lineitem GROUP BY ALL""")
def lineitem_totals(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(revenue), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("""SELECT event_type, count(*) AS events, count((props::JSON ->> 'k')::BIGINT) AS with_k, sum((props::JSON ->> 'k')::BIGINT)::BIGINT AS k FROM events GROUP BY event_type""")
def json_props(spark: SparkSession, root: str) -> DataFrame:
    """A field of a JSON column, read with its type; text that is no JSON has none."""
    k = F.from_json("props", "k long")["k"]
    return table(spark, root, "events", "event_type", "props").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count(k).alias("with_k"), F.sum(k).alias("k"))


@query(f"""WITH {_DOCS}, w AS (SELECT source_type, metadata['page_count']::INT AS pages, len(list_filter(string_split_regex(coalesce(raw_text, ''), '\\s+'), lambda x: x <> '')) AS words FROM docs WHERE metadata['page_count'] IS NOT NULL)
  SELECT lower(trim(source_type)) AS source_type, count(*) AS documents, round(avg(words / pages::DOUBLE), 6) AS words_per_page, count(*) FILTER (WHERE words / pages::DOUBLE < 120) AS slides FROM w GROUP BY 1""")
def page_density(spark: SparkSession, root: str) -> DataFrame:
    """Words per page of paged documents, by which slides are told from text."""
    pages = F.try_element_at("metadata", F.lit("page_count")).try_cast("int")
    words = F.size(F.filter(F.split(F.coalesce("raw_text", F.lit("")), r"\s+"), lambda w: w != ""))
    rows = _docs(spark, root, "metadata", "raw_text", "source_type").where(pages.isNotNull()).select(corpus.source_type("source_type").alias("source_type"), (words / pages.cast("double")).alias("density"))
    return rows.groupBy("source_type").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("density"), 6).alias("words_per_page"), F.count_if(F.col("density") < 120).alias("slides"))


from . import catalog_search, catalog_texts  # noqa: E402, F401  (they register more queries)
