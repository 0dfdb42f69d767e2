"""What texts ask for and hold: literals, tokens, citations, scores in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import questions
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read

REGISTRY = Registry()
query = REGISTRY.query


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '\b[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b'), ',') AS emails FROM documents")
def email_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(questions.emails(F.col("text")), ",").alias("emails"))


@query(r"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: strlen(x) >= 3)))::INTEGER AS n FROM documents")
def graph_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(questions.graph_tokens(F.col("text"))).alias("n"))


@query("SELECT conv_id, turn, conv_id::VARCHAR || ',' || turn::VARCHAR || ',7' AS cited FROM conversations")
def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.format_string("so [%d, %d] says, see [7] and [x]", "conv_id", "turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(questions.citations(answer).cast("array<string>"), ",").alias("cited"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 7 WHEN 1 THEN p_size * 30 WHEN 2 THEN p_size ELSE 1 END AS days FROM part")
def asked_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(F.lit("in den letzten %d Wochen"), F.lit("the last %d months"), F.lit("past %d days"), F.lit("since yesterday")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", questions.window_days(F.replace(said, F.lit("%d"), F.col("p_size").cast("string"))).alias("days"))


@query("SELECT event_id, round(value / 100 * exp(-greatest(date_diff('day', CAST(ts AS DATE), DATE '2024-02-01'), 0)::DOUBLE / 30) * (1 + ln(1 + user_id % 9)), 6) AS score FROM events")
def memory_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit("2024-02-01").cast("date"), F.col("ts").cast("date")).cast("double")
    return read(spark, sf_dir, "events").select("event_id", F.round(questions.memory_score(F.col("value") / 100, age, 30.0, F.col("user_id") % 9), 6).alias("score"))


@query("SELECT o_orderkey, round(greatest(0, least(1, 1 - 0.2::DOUBLE * (o_custkey % 7) - CASE o_orderstatus WHEN 'F' THEN 0.5::DOUBLE WHEN 'P' THEN 0.2::DOUBLE ELSE 0 END)), 6) AS score FROM orders")
def faithfulness_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("o_orderstatus") == "F", "bad").when(F.col("o_orderstatus") == "P", "weak")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(questions.faithfulness(F.col("o_custkey") % 7, verdict), 6).alias("score"))


@query("SELECT p_partkey, round(1000 * (p_partkey % 3) + 10 * (p_size % 5) + log10(p_size + 1), 6) AS score FROM part")
def schema_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.round(questions.schema_score(F.col("p_partkey") % 3, F.col("p_size") % 5, F.col("p_size")), 6).alias("score"))


@query(r"SELECT doc_id, round(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE length(regexp_replace(text, '[\p{L}\p{N}\s]', '', 'g')) / length(text) END, 6) AS share FROM documents")
def special_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.round(questions.special_share(F.col("text")), 6).alias("share"))
