"""The registered queries of the numbered operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import ann, bpe, document_sketches, html_extraction, importance_resampling, line_dedup, packing, pii, simhash, token_counts, toxicity, turn_repair, va_file
from quillspark.llm.common import scratch_path, table

VOCABULARY = "byte_bpe_50k"  # the contracts' vocabulary; every operator takes another by path


def _vocabulary(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.{kind}")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), max_bits=2, width=3)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs)).withColumnRenamed("id", "doc_id")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode_digests(table(spark, sf_dir, "documents"), _vocabulary("tiktoken"), public_tokenizers.PATTERN)
    return out.withColumnRenamed("id", "doc_id")


def op4_multiprobe_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)
    return out.withColumnRenamed("id", "doc_id")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a cache of its own, so that every text is encoded in this run
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), _vocabulary("json"), scratch_path(spark), limit=1024)
    return out.withColumnRenamed("id", "doc_id")


def op8_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_file.search(table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), _vocabulary("json"), length=2048, end_id=0)
    return out.withColumnRenamed("id", "doc_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), max_bits=3, least=0.8)
    return out.select("doc_id", "text", "n_lines", "n_removed")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    out = turn_repair.repair(turn_repair.damage(rows), rows)
    return out.withColumn("repaired_sha256", F.sha2(turn_repair.written(F.col("turns")), 256)).drop("turns")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=1, buckets=10_000, percent=10, least_words=20, seed=2024)
    return out.withColumnRenamed("id", "doc_id")


def op13_threshold_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = document_sketches.compare_edited(table(spark, sf_dir, "documents"), width=5, fraction=1 / 8, least=16)
    return out.withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_personal_data, op3_byte_bpe, op4_multiprobe_lsh, op5_toxicity, op6_html_text, op7_token_counts, op8_va_file, op9_best_fit_packing, op10_line_dedup, op11_turn_repair, op12_importance_resampling, op13_threshold_sketches)}


OP8_SQL = """
WITH numbers AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, q.v AS qv, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM numbers q JOIN numbers c ON (q.vec_id <> c.vec_id OR q.v <> c.v) AND len(q.v) = len(c.v)
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id, qv ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_va_file": OP8_SQL}
