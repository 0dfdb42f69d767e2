"""Communities of the entity graph, clusters of vectors, and checks of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import citations, clustering, communities
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read

REGISTRY = Registry()
query = REGISTRY.query


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts, linked by their orders of each year; every year is a graph."""
    return read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").alias("graph"), F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000_000).alias("dst"), F.col("l_quantity").alias("weight"))


@query()
def entity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.detect(_edges(spark, sf_dir), resolution=1.0, least=3)


@query()
def community_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest members and relations of each community, as text."""
    edges = _edges(spark, sf_dir)
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))
    names = names.unionByName(read(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("node"), F.col("p_name").alias("name")))
    names = names.crossJoin(F.broadcast(edges.select("graph").distinct()))  # a row for each year
    out = communities.summary_input(communities.detect(edges, resolution=1.0, least=3), edges, names, most_members=30, most_edges=40)
    return out.select("graph", "community", F.array_join("members", "\n").alias("members"), F.array_join("relations", "\n").alias("relations"))


@query()
def neighbour_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.neighbour_clusters(read(spark, sf_dir, "embeddings"), k=10, resolution=1.0, rounds=20)


@query()
def k_means_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.k_means(read(spark, sf_dir, "embeddings"), k=10, seed=1)[0]


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each document's first 300 characters as an answer that cites it, the next document and one that isn't there."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    said = F.concat(F.substring("text", 1, 150), F.lit(" [1]. "), F.substring("text", 151, 150), F.lit(" [2, 3]. "), F.lit("End of it [2]."))
    own = docs.select(F.col("doc_id").alias("answer_id"), F.lit(1).alias("n"), "text")
    after = docs.where("doc_id > 0").select((F.col("doc_id") - 1).alias("answer_id"), F.lit(2).alias("n"), "text")
    return docs.select(F.col("doc_id").alias("answer_id"), said.alias("text")), own.unionByName(after)


@query()
def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.check_citations(*_answers(spark, sf_dir))


@query()
def repetition_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their letters' case aside and white space gone, less what repeats over more than twelve characters."""
    out = citations.without_repetition(read(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.lower("text"), r"\s", "").alias("text")), 12, "doc_id")
    return out.select(F.col("id").alias("doc_id"), "removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))


@query()
def quoted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eighty characters of each document, in capitals, with other white space and quotes around, and where they stand."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    said = F.concat(F.lit("„"), F.regexp_replace(F.upper(F.substring("text", 21, 80)), r"\s+", "\n "), F.lit("“."))
    return citations.quote_spans(docs, docs.select("source_id", said.alias("quote"))).select("source_id", "start", "end")
