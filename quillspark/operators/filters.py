"""Which chunks and documents a search may see: equality, dates, ids, metadata, membership, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_tenant(chunks: DataFrame, tenant: str | int, files: list | None = None, tenant_col: str = "kb_id", file_col: str = "file_id") -> DataFrame:
    """Chunks of one tenant, and of some of its files if any are named."""
    out = chunks.where(F.col(tenant_col) == tenant)
    return out.where(F.col(file_col).isin(*files)) if files else out


def of_kind(chunks: DataFrame, kind: str | None, kind_col: str = "node_kind", hidden: str = "community_summary") -> DataFrame:
    """Chunks of a kind; if none is asked for, all but the hidden one. Null is no kind and stays."""
    return chunks.where(F.col(kind_col) == kind) if kind else chunks.where(~F.col(kind_col).eqNullSafe(F.lit(hidden)))


def with_metadata(rows: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose map holds every wanted pair."""
    for key, value in wanted.items():
        rows = rows.where(F.col(column)[key] == value)
    return rows


def effective_date(published: str = "published_at", created: str = "created_at") -> Column:
    return F.coalesce(F.col(published), F.col(created))


def in_window(rows: DataFrame, date: Column, first: str | None, last: str | None) -> DataFrame:
    """Rows whose date is in an inclusive window; an end that is None is open."""
    out = rows.where(date >= F.lit(first).cast("date")) if first else rows
    return out.where(date <= F.lit(last).cast("date")) if last else out


def both_ids(left: DataFrame | None, right: DataFrame, key: str = "file_id") -> DataFrame:
    """Ids in both tables; no left table or an empty one is no constraint."""
    if left is None or left.isEmpty():
        return right.select(key).distinct()
    return right.select(key).distinct().join(left.select(key), key, "left_semi")


def at_least(ranked: DataFrame, least: float, score: str = "score") -> DataFrame:
    return ranked.where(F.col(score) >= least)


def visible(bases: DataFrame, members: DataFrame, opted_out: DataFrame, key: str = "kb_id") -> DataFrame:
    """Bases with a membership and without an opted-out subscription."""
    return bases.join(members, key, "left_semi").join(opted_out, key, "left_anti")


def named(rows: DataFrame, pattern: str, name: str) -> DataFrame:
    """Rows whose name matches a pattern, letter case aside."""
    return rows.where(F.col(name).rlike(f"(?iu){pattern}"))


def newest(rows: DataFrame, date: Column, n: int, tie: str) -> DataFrame:
    return rows.orderBy(date.desc(), tie).limit(n)


def grade_action(grades: DataFrame, least: int = 3, rewritten: bool = False, query: str = "query_id", grade: str = "grade", file: str = "file_id") -> DataFrame:
    """(query_id, relevant, ambiguous, relevant_files, action) of graded chunks.

    With `least` relevant chunks, or relevant ones of a single file, go on; with fewer over several
    files the question is rewritten; with ambiguous ones alone go on; else abstain. After a
    rewrite any relevant or ambiguous chunk will do. Chunks without a file count for no file.
    """
    relevant = F.col(grade) == "relevant"
    files = F.countDistinct(F.when(relevant & (F.col(file) != ""), F.col(file)))
    out = grades.groupBy(query).agg(F.count_if(relevant).alias("relevant"), F.count_if(F.col(grade) == "ambiguous").alias("ambiguous"), files.alias("relevant_files"))
    some = (F.col("relevant") >= 1) | (F.col("ambiguous") >= 1)
    if rewritten:
        return out.withColumn("action", F.when(some, "proceed").otherwise("abstain"))
    enough = (F.col("relevant") >= least) | ((F.col("relevant") >= 1) & (F.col("relevant_files") == 1))
    return out.withColumn("action", F.when(enough, "proceed").when(F.col("relevant") >= 1, "rewrite").when(F.col("ambiguous") >= 1, "proceed").otherwise("abstain"))


def low_confidence(hits: DataFrame, least: float = 0.4, chunks: int = 3, query: str = "query_id", score: str = "score") -> DataFrame:
    """(query_id, low): fewer than `chunks` hits, or none of `least` or more."""
    out = hits.groupBy(query).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(F.col(score) >= least), F.lit(False)).alias("good"))
    return out.select(query, ((F.col("n") < chunks) | ~F.col("good")).alias("low"))
