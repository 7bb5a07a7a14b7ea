"""Queries of whole searches and of answers with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers
from ..operators import ann, answering, embedding, fusion, keyword, semantic, sessions
from ..tables import table
from . import search as searching
from .catalog import _BM25, _CHUNKS, _DOCS, _KEYS, _MSGS, _QUESTIONS, _STRIP, _VECTORS, _W, SQL, K, _chunks, _index, _messages, _vectors, query

_LIVE = _CHUNKS.replace("ch AS (", "every_ch AS (", 1) + ", ch AS (SELECT * FROM every_ch WHERE doc_id IN (SELECT id FROM project_documents))"
_CUT = lambda c: f"CASE WHEN starts_with({c}, '[Source:') AND strpos({c}, ']' || chr(10)) > 0 THEN {_STRIP(f'substr({c}, strpos({c}, chr(93) || chr(10)) + 2)')} WHEN starts_with({c}, '[Source:') AND strpos({c}, chr(10)) > 0 THEN {_STRIP(f'substr({c}, strpos({c}, chr(10)) + 1)')} ELSE {c} END"


def _found(top_k: int, min_score: float = 0.01, budget: int = 10_000) -> str:
    """SQL of a whole keyword search: over-fetched candidates, second-stage scores, and the choice among them one after the other."""
    return f"""{_QUESTIONS}, {_LIVE}, {_DOCS}, {_BM25.replace(f"rank <= {K}", f"rank <= {6 * top_k}")},
  pairs AS (SELECT t.query_id, t.chunk_id, t.rank, {_KEYS('q.text')} AS keys, regexp_extract_all(lower(q.text), {_W}) AS ws, c.text AS raw
    FROM top t JOIN questions q USING (query_id) JOIN ch c ON c.id = t.chunk_id WHERE t.score > 0),
  bare AS (SELECT *, list_distinct(CASE WHEN len(keys) > 0 THEN keys ELSE ws END) AS a, {_CUT('raw')} AS body FROM pairs),
  cut AS (SELECT *, {_STRIP('body')} AS t, regexp_extract_all(lower(body), {_W}) AS cw FROM bare),
  told AS (SELECT *, substr(t, 1, 1500) AS head, round(1 / (1 + exp(3.0 - 6.0 * (CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda w: list_contains(cw, w)))::DOUBLE / len(a) ELSE 0.0 END))), 6) AS score FROM cut),
  ends AS (SELECT *, CASE WHEN strpos(head, '.') > 0 THEN length(head) - strpos(reverse(head), '.') + 1 ELSE 0 END AS stop FROM told),
  short AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS pos,
    CASE WHEN length(t) > 1500 THEN CASE WHEN stop - 1 > 750 THEN substr(head, 1, stop) ELSE head || '...' END ELSE t END AS text FROM ends),
  items AS MATERIALIZED (SELECT *, list_distinct(regexp_extract_all(lower(text), {_W})) AS words FROM short),
  fold AS (
    SELECT DISTINCT query_id, 0::BIGINT AS pos, 0::BIGINT AS n, 0::BIGINT AS used, []::VARCHAR[][] AS seen, false AS stop, NULL::VARCHAR AS chunk_id, NULL::DOUBLE AS score, NULL::VARCHAR AS text FROM items
    UNION ALL
    SELECT query_id, pos, CASE WHEN ends OR again OR over THEN n ELSE n + 1 END, CASE WHEN ends OR again OR over THEN used ELSE used + length(text) END,
      CASE WHEN ends OR again THEN seen ELSE list_append(seen, words) END, ends OR over, CASE WHEN ends OR again OR over THEN NULL ELSE chunk_id END, score, text
    FROM (SELECT *, n > 0 AND NOT ends AND NOT again AND used + length(text) > {budget} AS over FROM
      (SELECT f.query_id, f.n, f.used, f.seen, i.pos, i.chunk_id, i.score, i.text, i.words, f.n > 0 AND (i.score < {min_score} OR f.n >= {top_k}) AS ends,
        len(list_filter(f.seen, lambda s: len(s) > 0 AND len(i.words) > 0 AND len(list_intersect(s, i.words)) > 0.7 * least(len(s), len(i.words)))) > 0 AS again
       FROM fold f JOIN items i ON i.query_id = f.query_id AND i.pos = f.pos + 1 WHERE NOT f.stop))),
  results AS (SELECT f.query_id, f.n::INT AS result_no, f.chunk_id, c.doc_id, f.text, f.score, c.start_char, c.end_char, c.strategy, d.title AS doc_title, d.source_type, d.source_url, d.confidence_level
    FROM fold f JOIN ch c ON c.id = f.chunk_id JOIN docs d ON d.id = c.doc_id)"""


SQL["keyword_search"] = f"WITH RECURSIVE {_found(10)} SELECT * FROM results"

_HEAD = "'[Source ' || result_no || '] ' || coalesce(doc_title, '') || CASE WHEN length(source_url) > 0 THEN ' (' || source_url || ')' ELSE '' END"
SQL["context_windows"] = f"""WITH RECURSIVE {_found(5)},
  windows AS (SELECT query_id, string_agg({_HEAD} || ' | chars ' || start_char || '-' || end_char || ' | score: ' || score || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY result_no) AS context FROM results GROUP BY query_id)
  SELECT q.query_id, coalesce(context, 'No relevant information found for: ' || q.text) AS context FROM questions q LEFT JOIN windows w ON w.query_id = q.query_id"""


@query(f"""WITH {_VECTORS}, asked_chunks AS (SELECT v.chunk_id, v.project_id, v.model_name, v.v, substr({_CUT('c.text')}, 1, 80) AS text FROM vecs v JOIN ch c ON c.id = v.chunk_id
    WHERE v.model_name = 'local-mini-64' AND ('0x' || substr(v.chunk_id, 5, 8))::BIGINT % 20 = 0),
  questions AS (SELECT chunk_id AS query_id, project_id, text FROM asked_chunks), {_BM25.replace(f"rank <= {K}", "rank <= 60")},
  near AS (SELECT q.chunk_id AS query_id, x.chunk_id, round((1 + list_cosine_similarity(q.v, x.v)) / 2, 6) AS score FROM asked_chunks q JOIN vecs x ON x.project_id = q.project_id AND x.model_name = q.model_name),
  nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM near) WHERE rank <= 60),
  bag AS (SELECT query_id, chunk_id, rank, 0 AS o FROM nearest UNION ALL SELECT query_id, chunk_id, rank, 1 FROM top WHERE score > 0),
  fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS fused, min(CASE WHEN o = 0 THEN rank END) AS r0, min(CASE WHEN o = 1 THEN rank END) AS r1 FROM bag GROUP BY ALL)
  SELECT * FROM (SELECT query_id, chunk_id, fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, r0 ASC NULLS LAST, r1 ASC NULLS LAST, chunk_id) AS rank FROM fused) WHERE rank <= 60""")
def hybrid_topk(spark: SparkSession, root: str) -> DataFrame:
    """Vector and keyword lists fused: the stated query set, every 20th chunk by its id, asks with its stored vector and its first words."""
    vectors = _vectors(spark, root).where("model_name = 'local-mini-64'")
    asked = vectors.where(F.conv(F.substring("chunk_id", 5, 8), 16, 10).cast("long") % 20 == 0)
    texts = _chunks(spark, root, "text").select(F.col("id").alias("chunk_id"), F.substring(searching.strip_context_prefix("text"), 1, 80).alias("text"))
    asked = asked.join(texts, "chunk_id").withColumnRenamed("chunk_id", "query_id")
    lists = (semantic.search(vectors, asked, 60), keyword.search(_index(spark, root), asked.select("query_id", "project_id", "text"), 60))
    return fusion.fuse(*lists, most=60).withColumn("rank", F.col("rank").cast("long"))


@query(SQL["semantic_topk"])
def indexed_topk(spark: SparkSession, root: str) -> DataFrame:
    """The nearest vectors as in the exact query, by the index of lists; exact for projects up to ``ann.EXACT`` vectors."""
    vectors = _vectors(spark, root)
    asked = vectors.where(F.conv(F.substring("chunk_id", 5, 8), 16, 10).cast("long") % 20 == 0).withColumn("query_id", F.concat_ws("/", "chunk_id", "model_name"))
    found = ann.search(ann.build(vectors, K), asked.select("query_id", "project_id", "model_name", "vector"), K)
    return found.select("query_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


_CITED = f"""{_MSGS}, results AS (SELECT id AS query_id, unnest(citations) AS c, generate_subscripts(citations, 1) AS result_no FROM msgs WHERE len(citations) > 0),
  flat AS (SELECT query_id, result_no, c.text AS text, c.doc_title AS doc_title, c.source_url AS source_url FROM results)"""


@query(f"""WITH {_CITED}, blocks AS (SELECT query_id, string_agg({_HEAD} || ':' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY result_no) AS t FROM flat GROUP BY query_id)
  SELECT m.id AS query_id, '--- SOURCES ---' || coalesce(chr(10) || t, '') AS sources FROM msgs m LEFT JOIN blocks b ON b.query_id = m.id WHERE m.role = 'assistant'""")
def source_blocks(spark: SparkSession, root: str) -> DataFrame:
    """The block of sources that each stored answer was given."""
    rows = _messages(spark, root).where(sessions.role() == "assistant").select(F.col("id").alias("query_id"), "citations")
    results = rows.select("query_id", F.posexplode("citations").alias("n", "c"))
    results = results.select("query_id", (F.col("n") + 1).alias("result_no"), F.coalesce("c.text", F.lit("")).alias("text"), "c.doc_title", "c.source_url")
    return answering.source_blocks(rows, results)


def _leaks() -> str:
    out = "coalesce(content, '')"
    for pattern in answers.LEAKS:
        out = f"regexp_replace({out}, '{pattern.replace('{name}', 'Assistant')}', '', 'g')"
    return out


_CIT = answers.CITATION
_BREAK = "chr(10) || chr(10)"
SQL["answers_grounded"] = f"""WITH {_MSGS}, a AS (SELECT id, coalesce(len(citations), 0) AS n, string_split({_leaks()}, {_BREAK}) AS ps FROM msgs WHERE role = 'assistant'),
  p AS (SELECT id, n, list_transform(ps, lambda x: {{'kept': [x], 'seen': CASE WHEN length({_STRIP('x')}) >= 80 THEN [list_distinct(regexp_extract_all(lower({_STRIP('x')}), {_W}))] ELSE []::VARCHAR[][] END, 'none': length({_STRIP('x')}) = 0}}) AS ps FROM a),
  d AS (SELECT id, n, list_reduce(list_prepend({{'kept': []::VARCHAR[], 'seen': []::VARCHAR[][], 'none': false}}, ps), lambda s, x: CASE
      WHEN x.none OR (len(x.seen) > 0 AND len(list_filter(s.seen, lambda o: least(len(o), len(x.seen[1])) > 0 AND len(list_intersect(o, x.seen[1])) > 0.8 * least(len(o), len(x.seen[1])))) > 0) THEN s
      ELSE {{'kept': list_concat(s.kept, x.kept), 'seen': list_concat(s.seen, x.seen), 'none': false}} END).kept AS kept FROM p),
  c AS (SELECT id, n, {_STRIP(f"regexp_replace(array_to_string(kept, {_BREAK}), '{chr(92)}n{{3,}}', {_BREAK}, 'g')")} AS t FROM d),
  u AS (SELECT *, list_filter(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(t, '{_CIT}', 1), lambda x: TRY_CAST(x AS INT)), lambda x: x IS NOT NULL))), lambda x: x >= 1 AND x <= n) AS used,
    {' OR '.join(f"contains(lower(t), '{p.replace(chr(39), chr(39) * 2)}')" for p in answers.REFUSALS)} AS refusal,
    regexp_extract_all(t, '{_CIT}', 0) AS marks, string_split_regex(t, '{_CIT}') AS between FROM c),
  r AS (SELECT *, list_transform(marks, lambda m: CASE WHEN coalesce(list_position(used, TRY_CAST(regexp_extract(m, '{_CIT}', 1) AS INT)), 0) > 0 THEN '[Source ' || list_position(used, TRY_CAST(regexp_extract(m, '{_CIT}', 1) AS INT)) || ']' ELSE m END) AS said,
    n = 0 AS none, starts_with(t, 'Error generating answer:') AS failed FROM u),
  g AS (SELECT id, NOT none AND NOT failed AND (len(used) > 0 OR NOT refusal) AS sufficient, n, used, none, failed,
    CASE WHEN none THEN '{answering.NO_SOURCES.replace(chr(39), chr(39) * 2)}' ELSE array_to_string(list_transform(between, lambda x, i: x || coalesce(said[i], '')), '') END AS answer FROM r),
  l AS (SELECT *, regexp_extract_all(answer, '\\[(?:[Ss]ources?\\s*)?(\\d+(?:\\s*,\\s*\\d+)*)\\]', 1) AS nums, string_split_regex(answer, '\\[(?:[Ss]ources?\\s*)?(\\d+(?:\\s*,\\s*\\d+)*)\\]') AS parts FROM g)
  SELECT id, answer, array_to_string(CASE WHEN sufficient AND len(used) = 0 THEN generate_series(1, n) WHEN failed OR none THEN [] ELSE used END, ',') AS used, sufficient,
    array_to_string(list_transform(parts, lambda x, i: x || coalesce(array_to_string(list_transform(string_split_regex(nums[i], '\\s*,\\s*'), lambda k: '[' || k || '](#source-' || k || ')'), ' '), '')), '') AS linked FROM l"""


@query(f"""WITH {_CHUNKS}, models AS (SELECT DISTINCT model_name FROM chunk_embeddings WHERE model_name IS NOT NULL),
  held AS (SELECT chunk_id, model_name, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, model_name ORDER BY created_at DESC, id DESC) AS r FROM chunk_embeddings) WHERE r = 1)
  SELECT m.model_name, count(*) FILTER (WHERE h.content_hash = sha256(c.text)) AS cached, count(*) FILTER (WHERE (h.content_hash = sha256(c.text)) IS NOT TRUE) AS changed
  FROM models m CROSS JOIN ch c LEFT JOIN held h ON h.chunk_id = c.id AND h.model_name = m.model_name WHERE c.text IS NOT NULL GROUP BY m.model_name""")
def cached_counts(spark: SparkSession, root: str) -> DataFrame:
    """How many chunks have a vector of each model for their present text, and how many don't."""
    from functools import reduce

    chunks, store = _chunks(spark, root, "text"), table(spark, root, "chunk_embeddings", "id", "chunk_id", "model_name", "content_hash", "created_at")
    models = [r[0] for r in store.select("model_name").where("model_name IS NOT NULL").distinct().collect()]  # a handful of names
    plans = [embedding.plan(chunks, store, m).groupBy(F.lit(m).alias("model_name")).agg(F.count_if("is_cached").alias("cached"), F.count_if(~F.col("is_cached")).alias("changed")) for m in models]
    return reduce(lambda a, b: a.unionByName(b), plans)


@query("""WITH gone AS (SELECT DISTINCT c.id FROM chunks c JOIN project_documents d ON d.id = c.doc_id WHERE d.processing_status = 'failed' OR d.confidence_level = 2)
  SELECT id, chunk_id, model_name, count(*) AS deliveries FROM chunk_embeddings WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT id FROM gone) GROUP BY ALL""")
def vector_delete(spark: SparkSession, root: str) -> DataFrame:
    """What the vector store keeps when the vectors of fetched and failed documents are deleted."""
    docs = table(spark, root, "project_documents", "id", "processing_status", "confidence_level").where("processing_status = 'failed' OR confidence_level = 2")
    gone = table(spark, root, "chunks", "id", "doc_id").join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("id").alias("chunk_id"))
    left = semantic.without(table(spark, root, "chunk_embeddings", "id", "chunk_id", "model_name"), gone)
    return left.groupBy("id", "chunk_id", "model_name").agg(F.count(F.lit(1)).alias("deliveries"))


@query(f"""WITH {_CHUNKS}, now AS (SELECT c.project_id, count(*) AS n, p.last_indexed_at FROM ch c JOIN projects p ON p.id = c.project_id GROUP BY ALL),
  seen AS (SELECT c.project_id, count(*) AS n, p.last_indexed_at FROM ch c JOIN projects p ON p.id = c.project_id WHERE c.created_at <= p.last_indexed_at GROUP BY ALL)
  SELECT n.project_id FROM now n LEFT JOIN seen s ON s.project_id = n.project_id WHERE s.n IS NULL OR s.n <> n.n OR n.last_indexed_at IS DISTINCT FROM s.last_indexed_at""")
def stale_projects(spark: SparkSession, root: str) -> DataFrame:
    """Projects with chunks that came after they were last indexed, so that their keyword index must be built anew."""
    chunks = _chunks(spark, root, "project_id", "created_at").join(table(spark, root, "projects", F.col("id").alias("project_id"), "last_indexed_at"), "project_id")
    count = lambda df: df.groupBy("project_id", "last_indexed_at").agg(F.count(F.lit(1)).alias("n"))
    return keyword.stale(count(chunks), count(chunks.where(F.col("created_at") <= F.col("last_indexed_at"))))
