"""Retrieval over documents and embeddings: keyword, vector, fusion and what follows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import or_tokens
from quillspark.operators import chunks, fusion, keyword, rerank, vector
from quillspark.sources.tables import read

K = 10
_WINDOW = 400  # characters of a chunk in these queries


def _list(spark: SparkSession, sf_dir: str, measure: str, k: int = 50) -> DataFrame:
    return keyword.best(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k, measure)


def bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "bm25", K).select("query_id", "id", "rank", "score")


def coverage_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _list(spark, sf_dir, "coverage", K).select("query_id", "id", "rank", "score")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms of 50 candidates a query, fused by weighted ranks."""
    fused = fusion.rank_fusion([(_list(spark, sf_dir, "bm25"), 1.0), (_list(spark, sf_dir, "coverage"), 0.5)])
    return keyword.top_k(fused, K).select("query_id", "id", "rank", "score")


def rerank_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = fusion.blend(_list(spark, sf_dir, "bm25"), _list(spark, sf_dir, "coverage"), 0.7)
    return mixed.select("query_id", "id", "score")


def feedback_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(-1)).alias("net"))
    return fusion.with_feedback(_list(spark, sf_dir, "bm25", K), net, 0.1)


def score_drop_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.cut_at_drop(_list(spark, sf_dir, "bm25", K), 0.8).select("query_id", "id", "rank")


def sandwich_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.sandwich(_list(spark, sf_dir, "bm25", K)).select("query_id", "id", "pos")


def cosine_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return vector.cosine_top_k(rows, rows.where("vec_id % 50 = 0"), K).select("query_id", "id", "rank", "score")


def truncated_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two passes: 5 * K candidates on the first 16 dimensions, ranked by whole vectors."""
    rows = read(spark, sf_dir, "embeddings")
    short = rows.select("vec_id", vector.truncated(F.col("embedding"), 16).alias("embedding")).where("embedding IS NOT NULL")
    found = vector.cosine_top_k(short, short.where("vec_id % 50 = 0"), 5 * K).select("query_id", "id")
    found = found.repartition(spark.sparkContext.defaultParallelism, "id")  # few small rows, but each costs a cosine
    both = found.join(rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), "query_id").join(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id")
    again = both.select("query_id", "id", F.round(vector.cosine(F.col("q"), F.col("v")), 6).alias("score"))
    return keyword.top_k(again, K).select("query_id", "id", "rank", "score")


def or_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", F.size(or_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold each benchmark text, letter case aside; the patterns are a stated, small set."""
    return keyword.mentions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "text", "item_id", "text")


def neighbour_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = chunks.windows(read(spark, sf_dir, "documents"), _WINDOW)
    hits = parts.select(F.lit(0).alias("query_id"), "doc_id", "chunk_index")
    return chunks.with_neighbours(hits, parts, 1).select("doc_id", "chunk_index", "content")


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.windows(read(spark, sf_dir, "documents"), _WINDOW)


def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.split(read(spark, sf_dir, "documents"), 512, 100)


def first_of_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.first_of_content(read(spark, sf_dir, "documents")).select("doc_id", "content_hash")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"), "text", "n_chars")
    return docs.join(F.broadcast(_list(spark, sf_dir, "bm25")), "id")  # 50 rows a query of a stated set: texts stay where they are


def near_copy_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rerank.without_near_copies(_candidates(spark, sf_dir).select("query_id", "id", "group_id", "rank", "text", "score")).select("query_id", "id", "rank")


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).where(F.col("rank") <= 2 * K).withColumn("score", fusion.min_max(F.col("score")))
    return rerank.diversified(rows.select("query_id", "id", "group_id", "rank", "text", "score"), K).select("query_id", "id", "pick")


def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select("query_id", "id", "score", F.floor(F.col("n_chars") / 4).cast("long").alias("tokens"), F.col("rank").alias("pos"))
    return rerank.within_budget(rows, 4000).select("query_id", "id", "pos")


QUERIES = {f.__name__: f for f in (bm25_top_k, coverage_top_k, hybrid_search, rerank_blend, feedback_prior, score_drop_cut, sandwich_order, cosine_top_k, truncated_cosine, or_token_counts, mention_counts, neighbour_expansion, chunk_windows, recursive_chunks, first_of_content, near_copy_removal, diversified, token_budget)}

_TERMS = r"""
WITH terms AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS lexeme FROM benchmark),
p AS (SELECT doc_id, lexeme, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS lexeme FROM terms) WHERE lexeme IN (SELECT lexeme FROM q) GROUP BY ALL),
len AS (SELECT doc_id, len(list_distinct(t)) AS dl FROM terms),
c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
df AS (SELECT lexeme, count(*) AS df FROM p GROUP BY lexeme),
w AS (SELECT doc_id, lexeme, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS w
      FROM p JOIN df USING (lexeme) JOIN len USING (doc_id), c),
bm AS (SELECT item_id AS query_id, doc_id AS id, round(sum(w), 6) AS score FROM w JOIN q USING (lexeme) GROUP BY ALL),
cv AS (SELECT item_id AS query_id, doc_id AS id, round(count(*) / any_value(m)::DOUBLE, 6) AS score
       FROM p JOIN q USING (lexeme) JOIN (SELECT item_id, count(*) AS m FROM q GROUP BY item_id) USING (item_id) GROUP BY ALL),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM bm),
v AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM cv)
"""
_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[]))"
_CHUNKS = """
chunks AS (SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(ceil(length(text) / 400.0) AS INTEGER) AS total, substring(text, i * 400 + 1, 400) AS content
           FROM documents, unnest(range(0, CAST(ceil(length(text) / 400.0) AS BIGINT))) AS x(i) WHERE length(text) > 0)
"""
_HASH = r"lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')))"

ORACLES = {
    "bm25_top_k": _TERMS + "SELECT query_id, id, rank, score FROM b WHERE rank <= 10",
    "coverage_top_k": _TERMS + "SELECT query_id, id, rank, score FROM v WHERE rank <= 10",
    "hybrid_search": _TERMS + """
, f AS (SELECT query_id, id, round(sum(s), 6) AS score FROM (
    SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS s FROM b WHERE rank <= 50
    UNION ALL SELECT query_id, id, 0.5::DOUBLE / (60 + rank) FROM v WHERE rank <= 50) GROUP BY ALL)
SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM f) WHERE rank <= 10""",
    "rerank_blend": _TERMS + """
, j AS (SELECT b.query_id, b.id, b.score AS s, coalesce(v.score, 0) AS r FROM b LEFT JOIN (SELECT * FROM v WHERE rank <= 50) v USING (query_id, id) WHERE b.rank <= 50),
m AS (SELECT *, min(s) OVER w AS s0, max(s) OVER w AS s1, min(r) OVER w AS r0, max(r) OVER w AS r1 FROM j WINDOW w AS (PARTITION BY query_id))
SELECT query_id, id, round(0.7::DOUBLE * CASE WHEN r0 = r1 THEN 1.0::DOUBLE ELSE (r - r0) / (r1 - r0) END + (1 - 0.7::DOUBLE) * CASE WHEN s0 = s1 THEN 1.0::DOUBLE ELSE (s - s0) / (s1 - s0) END, 6) AS score FROM m""",
    "feedback_prior": _TERMS + """
, net AS (SELECT doc_id, sum(CASE WHEN quality = 1 THEN 1 ELSE -1 END) AS net FROM labels GROUP BY doc_id)
SELECT query_id, id, round(score + 0.1::DOUBLE * tanh(coalesce(net, 0) / 2.0::DOUBLE), 6) AS score FROM b LEFT JOIN net ON id = doc_id WHERE rank <= 10""",
    "score_drop_cut": _TERMS + """
, t AS (SELECT *, score < 0.8::DOUBLE * max(score) OVER (PARTITION BY query_id) AS low FROM b WHERE rank <= 10)
SELECT query_id, id, rank FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.query_id = t.query_id AND u.low AND u.rank <= t.rank)""",
    "sandwich_order": _TERMS + """
, t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM b WHERE rank <= 10)
SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank % 2 = 1 OR n <= 2 THEN rank ELSE 1000000000 - rank END) AS INTEGER) AS pos FROM t""",
    "cosine_top_k": f"""
WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0)
SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM s) WHERE rank <= 10""",
    "truncated_cosine": f"""
WITH e AS (SELECT vec_id, embedding, CAST(embedding[1:16] AS DOUBLE[]) AS h FROM embeddings),
s AS (SELECT q.vec_id AS query_id, d.vec_id AS id, round(list_cosine_similarity(q.h, d.h), 6) AS score, round({_COSINE}, 6) AS whole FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM s) WHERE n <= 50)
SELECT * FROM (SELECT query_id, id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, id) AS INTEGER) AS rank, whole AS score FROM c) WHERE rank <= 10""",
    "or_token_counts": r"SELECT item_id, len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{Nd}_-]+')))::BIGINT AS n_tokens FROM benchmark",
    "mention_counts": "SELECT item_id, count(*) AS n_documents FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) GROUP BY item_id",
    "neighbour_expansion": f"WITH {_CHUNKS} SELECT h.doc_id, h.chunk_index, string_agg(c.content, chr(10) || chr(10) ORDER BY c.chunk_index) AS content FROM chunks h JOIN chunks c ON h.doc_id = c.doc_id AND c.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 GROUP BY ALL",
    "chunk_windows": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "first_of_content": f"""
WITH h AS (SELECT doc_id, CASE WHEN {_HASH} = '' THEN '' ELSE sha256({_HASH}) END AS content_hash FROM documents)
SELECT doc_id, content_hash FROM h WHERE content_hash = '' UNION ALL SELECT min(doc_id), content_hash FROM h WHERE content_hash <> '' GROUP BY content_hash""",
}
