"""Searches over a stored keyword index that three batches of changes have made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import text_index
from quillspark.operators.scratch import Rounds
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read

REGISTRY = Registry()
query = REGISTRY.query


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """All documents; then every tenth is deleted; then every twentieth is back with one more word."""
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("id"), "text")
    at = lambda day: F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp").alias("at")
    deleted = docs.where("id % 10 = 0").select("corpus", "id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("deleted"), at(2))
    again = docs.where("id % 20 = 0").select("corpus", "id", F.concat(F.coalesce("text", F.lit("")), F.lit(" again")).alias("text"), F.lit(False).alias("deleted"), at(3))
    return [docs.select("*", F.lit(False).alias("deleted"), at(1)), deleted, again]


def _over_index(spark: SparkSession, sf_dir: str, run: Callable[[text_index.TextIndex], DataFrame]) -> DataFrame:
    with Rounds(spark) as rounds:
        index = text_index.TextIndex(spark, f"{rounds.root}/index")
        for n, changes in enumerate(_batches(spark, sf_dir)):
            index.apply(n, changes)
        return rounds.result(run(index))


_DOCS = r"""
WITH docs AS (SELECT lang AS corpus, doc_id AS id, text FROM documents WHERE doc_id % 10 <> 0
              UNION ALL SELECT lang, doc_id, coalesce(text, '') || ' again' FROM documents WHERE doc_id % 20 = 0),
tokens AS (SELECT corpus, id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM docs),
postings AS (SELECT corpus, id, lexeme, count(*) AS tf FROM (SELECT corpus, id, unnest(t) AS lexeme FROM tokens) GROUP BY ALL),
df AS (SELECT corpus, lexeme, count(*) AS df FROM postings GROUP BY ALL),
sizes AS (SELECT corpus, count(*) AS n, avg(len(list_distinct(t))) AS avgdl FROM tokens GROUP BY corpus)
"""


@query(_DOCS + "SELECT corpus, lexeme, df FROM df")
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_index(spark, sf_dir, lambda index: index.terms())


@query(_DOCS + "SELECT s.corpus, n, round(avgdl, 6) AS avgdl, strftime((SELECT max(x) FROM unnest([DATE '2024-01-01', CASE WHEN ten THEN DATE '2024-01-02' END, CASE WHEN twenty THEN DATE '2024-01-03' END]) AS u(x)), '%Y-%m-%d') AS refreshed FROM sizes s JOIN (SELECT lang AS corpus, bool_or(doc_id % 10 = 0) AS ten, bool_or(doc_id % 20 = 0) AS twenty FROM documents GROUP BY lang) USING (corpus)")
def index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_index(spark, sf_dir, lambda index: index.sizes().select("corpus", "n", F.round("avgdl", 6).alias("avgdl"), F.date_format("at", "yyyy-MM-dd").alias("refreshed")))


@query("""
WITH newest AS (SELECT lang AS corpus, max(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (doc_id % 200)) AS newest FROM documents GROUP BY lang),
known AS (SELECT lang AS corpus, max(TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CASE WHEN doc_id % 20 = 0 THEN 2 WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END) AS refreshed FROM documents GROUP BY lang)
SELECT corpus, strftime(newest, '%Y-%m-%d %H:%M:%S') AS newest FROM newest JOIN known USING (corpus) WHERE refreshed < newest OR refreshed < TIMESTAMP '2024-01-04' - INTERVAL 12 HOUR""")
def stale_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpora whose statistics are older than their newest document or than twelve hours."""
    hours = (F.col("doc_id") % 200) * 3600
    newest = read(spark, sf_dir, "documents").groupBy(F.col("lang").alias("corpus")).agg(F.max(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + hours)).alias("newest"))
    return _over_index(spark, sf_dir, lambda index: text_index.stale(newest, index.sizes(), "2024-01-04 00:00:00", 12.0).select("corpus", F.date_format("newest", "yyyy-MM-dd HH:mm:ss").alias("newest")))


_SCORED = """
, asked AS (SELECT DISTINCT query_id, corpus, unnest(terms) AS lexeme FROM parts),
scored AS (SELECT query_id, corpus, id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM postings JOIN asked USING (corpus, lexeme) JOIN df USING (corpus, lexeme) JOIN sizes USING (corpus) JOIN (SELECT corpus, id, len(list_distinct(t)) AS dl FROM tokens) USING (corpus, id) GROUP BY ALL),
held AS (SELECT query_id, corpus, id FROM parts JOIN tokens USING (corpus)
  WHERE CASE WHEN phrase THEN len(list_filter(range(1, len(t) - len(terms) + 2), lambda i: t[i:i + len(terms) - 1] = terms)) > 0 ELSE list_has_any(t, terms) END
  GROUP BY ALL HAVING count(*) = any_value(n_parts))
SELECT query_id, corpus, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, corpus ORDER BY score DESC, id) AS rank FROM scored JOIN held USING (query_id, corpus, id)) WHERE rank <= 10
"""


@query(_DOCS + r"""
, parts AS (SELECT item_id AS query_id, corpus, false AS phrase, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS terms, 1 AS n_parts FROM benchmark, (SELECT DISTINCT corpus FROM docs) WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+')) > 0)
""" + _SCORED)
def stored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts, asked of every language, by the stored statistics."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", r"[^\p{L}\p{N}\s]", " ").alias("text"))
    asked = asked.crossJoin(F.broadcast(read(spark, sf_dir, "documents").select(F.col("lang").alias("corpus")).distinct()))
    return _over_index(spark, sf_dir, lambda index: text_index.search(index, asked, 10))


@query(_DOCS + r"""
, words AS (SELECT doc_id AS query_id, lang AS corpus, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id % 100 = 0),
parts AS (SELECT query_id, corpus, unnest([true, true, false]) AS phrase, unnest([w[1:2], w[4:6], w[7:9]]) AS terms, 3 AS n_parts FROM words WHERE len(w) >= 9)
""".replace("w[7:9]", "list_distinct(w[7:9])") + _SCORED)
def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two quoted phrases and three loose words of each hundredth document, asked of its language."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    rows = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("lang").alias("corpus"), w.alias("w")).where("size(w) >= 9")
    said = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    asked = rows.select("query_id", "corpus", F.concat(F.lit('"'), said(1, 2), F.lit('" '), said(7, 3), F.lit(" „"), said(4, 3), F.lit("“")).alias("text"))
    return _over_index(spark, sf_dir, lambda index: text_index.search(index, asked, 10))
