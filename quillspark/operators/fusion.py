"""Fusing, blending and adjusting ranked lists (query_id, id, score, rank)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def rank_fusion(lists: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """(query_id, id, score): the sum of weight / (k + rank), ranks from 1; lists of weight 0 or less are left out."""
    parts = [d.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for d, w in lists if w > 0]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.round(F.sum("s"), 6).alias("score"))


def min_max(score: Column, query: str = "query_id") -> Column:
    """The score scaled to 0..1 within its query; 1 where all are equal."""
    w = Window.partitionBy(query)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, 1.0).otherwise((score - low) / (high - low))


def blend(base: DataFrame, rerank: DataFrame, alpha: float) -> DataFrame:
    """(query_id, id, score): alpha * rerank + (1 - alpha) * base, both scaled per query; a missing rerank score is 0."""
    both = base.select("query_id", "id", F.col("score").alias("b")).join(rerank.select("query_id", "id", F.col("score").alias("r")), ["query_id", "id"], "left").fillna(0.0, ["r"])
    score = F.col("r") if alpha >= 1 else alpha * min_max(F.col("r")) + (1 - alpha) * min_max(F.col("b"))
    return both.select("query_id", "id", F.round(score, 6).alias("score"))


def with_feedback(ranked: DataFrame, net: DataFrame, weight: float) -> DataFrame:
    """net: (id, net). Adds weight * tanh(net / 2)."""
    out = ranked.join(net, "id", "left").fillna(0, ["net"])
    return out.select("query_id", "id", F.round(F.col("score") + weight * F.tanh(F.col("net") / 2), 6).alias("score"))


def recency(age_days: Column, half_life: float) -> Column:
    """2 to the power of minus age over half-life; a negative age counts as 0."""
    return F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / half_life)


def bridge(n: Column) -> Column:
    return F.least(F.coalesce(n, F.lit(0)), F.lit(3)) / 3


def cut_at_drop(ranked: DataFrame, threshold: float) -> DataFrame:
    """The rows before the first whose score is below threshold times the query's top score."""
    w = Window.partitionBy("query_id")
    top = F.max("score").over(w)
    failing = F.min(F.when(F.col("score") < threshold * F.col("top"), F.col("rank"))).over(w)
    out = ranked.withColumn("top", top).withColumn("fails", failing)
    return out.where("fails IS NULL OR rank < fails").drop("top", "fails")


def sandwich(ranked: DataFrame) -> DataFrame:
    """pos from 1: odd ranks from the front, even ranks from the end backwards; up to two rows stay as they are."""
    n = F.count("*").over(Window.partitionBy("query_id"))
    key = F.when((F.col("rank") % 2 == 1) | (F.col("n") <= 2), F.col("rank")).otherwise(1_000_000_000 - F.col("rank"))
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy("key"))
    return ranked.withColumn("n", n).withColumn("key", key).withColumn("pos", pos).drop("n", "key")


def with_recency(ranked: DataFrame, ages: DataFrame, weight: float, half_life: float) -> DataFrame:
    """ages: (id, age_days). Adds weight * recency; rows without an age stay as they are."""
    out = ranked.join(ages, "id", "left")
    gain = F.coalesce(weight * recency(F.col("age_days").cast("double"), half_life), F.lit(0.0))
    return out.select("query_id", "id", F.round(F.col("score") + gain, 6).alias("score"))


def with_bridges(ranked: DataFrame, tally: DataFrame, weight: float) -> DataFrame:
    """tally: (id, n). Adds weight * min(n, 3) / 3."""
    out = ranked.join(tally, "id", "left")
    return out.select("query_id", "id", F.round(F.col("score") + weight * bridge(F.col("n")), 6).alias("score"))


def score_spread(ranked: DataFrame) -> DataFrame:
    """(query_id, spread): population deviation of scores; 0 of fewer than two."""
    return ranked.groupBy("query_id").agg(F.round(F.when(F.count("score") < 2, 0.0).otherwise(F.stddev_pop("score")), 6).alias("spread"))


def union_once(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """Rows (query_id, *key, rank, ...) of several lists, the first of each key by list and rank."""
    parts = reduce(DataFrame.unionByName, [d.withColumn("source", F.lit(i)) for i, d in enumerate(lists)])
    nth = F.row_number().over(Window.partitionBy("query_id", *key).orderBy("source", "rank"))
    return parts.withColumn("nth", nth).where("nth = 1").drop("nth")


def batches(ranked: DataFrame, size: int) -> DataFrame:
    """Adds batch from 0: slices of `size` rows in rank order."""
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("int"))


def keyword_floor(final: DataFrame, keyword: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, group_id, score, rank): final (query_id, id, group_id, score, rank) with the best keyword
    row of each of the max(limit / 2, 4) first groups of keyword (query_id, id, group_id, rank) at the top score.

    Rows that have to make room go from the end: first those of groups without a keyword row.
    """
    first = Window.partitionBy("query_id", "group_id").orderBy("rank")
    best = keyword.where("coalesce(group_id, '') <> ''").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    best = best.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("nth") <= max(limit // 2, 4))
    best = best.select("query_id", "id", "group_id", F.lit(True).alias("kept"), F.col("rank").alias("krank"))
    groups = best.select("query_id", "group_id", F.lit(True).alias("strong")).distinct()
    both = final.join(best.drop("group_id"), ["query_id", "id"], "full").join(best.select("query_id", "id", F.col("group_id").alias("kgroup")), ["query_id", "id"], "left")
    both = both.withColumn("group_id", F.coalesce("group_id", "kgroup")).drop("kgroup").join(groups, ["query_id", "group_id"], "left")
    every = Window.partitionBy("query_id")
    both = both.withColumn("score", F.when(F.col("kept"), F.max("score").over(every)).otherwise(F.col("score")))
    # what stays longest: rows put in, then groups with keyword rows, each by the place they had
    order = every.orderBy(F.col("rank").isNotNull(), F.coalesce("strong", F.lit(False)).desc(), F.coalesce("rank", "krank"))
    stay = both.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit)
    rank = F.row_number().over(every.orderBy(F.desc("score"), F.col("rank").isNull(), "rank", "krank"))
    return stay.select("query_id", "id", "group_id", "score", rank.alias("rank"))
