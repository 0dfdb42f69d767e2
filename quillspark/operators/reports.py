"""Operational reports: plain aggregates over turns, sources, files and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worst(net: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """Rows (id, net) of a negative net, the lowest first."""
    return net.where("net < 0").orderBy("net", id_col).limit(n)


def tool_mix(turns: DataFrame, calls: str = "calls") -> DataFrame:
    """(tool, n, median, error_rate) of turns with an array of (tool, duration, failed)."""
    rows = turns.select(F.explode(calls).alias("c")).select("c.*")
    return rows.groupBy("tool").agg(F.count("*").alias("n"), F.round(F.percentile("duration", F.lit(0.5)), 6).alias("median"), F.round(F.count_if("failed") / F.count("*"), 6).alias("error_rate"))


def sync_stats(sources: list[DataFrame]) -> DataFrame:
    """(kb, sources, last, failing) of several kinds of sources (kb, synced, failures)."""
    every = reduce(DataFrame.unionByName, [s.select("kb", "synced", "failures") for s in sources])
    return every.groupBy("kb").agg(F.count("*").alias("sources"), F.max("synced").alias("last"), F.bool_or(F.col("failures") > 0).alias("failing"))


def sync_age(sources: dict[str, DataFrame], now: str) -> DataFrame:
    """(kb, kind, seconds) since the oldest success, or attempt where there is none, of each kind of source (kb, succeeded, attempted)."""
    every = reduce(DataFrame.unionByName, [s.select("kb", F.lit(k).alias("kind"), F.coalesce("succeeded", "attempted").alias("at")) for k, s in sources.items()])
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.min("at").cast("timestamp"))
    return every.groupBy("kb", "kind").agg(age.alias("seconds"))


def history(metrics: DataFrame, name: str, first: str, last: str) -> DataFrame:
    """(at, value) of one metric in a span of time, in order."""
    span = F.col("at").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))
    return metrics.where((F.col("name") == name) & span).select("at", "value").orderBy("at", "value")


def turn_counts(turns: DataFrame, recent: Column) -> DataFrame:
    """One row (turns, asked, answered, recent)."""
    return turns.agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), F.count_if(F.col("role") == "assistant").alias("answered"), F.count_if(recent).alias("recent"))


def snapshot(metrics: dict[str, DataFrame]) -> DataFrame:
    """(name, value): the one number of each frame."""
    parts = [d.select(F.lit(n).alias("name"), F.col(d.columns[0]).cast("double").alias("value")) for n, d in metrics.items()]
    return reduce(DataFrame.unionByName, parts)


def daily_scores(answers: DataFrame, schema: str = "array<struct<score: double>>") -> DataFrame:
    """(day, mean, answers) of answers (id, at, sources as JSON)."""
    rows = answers.select("id", F.col("at").cast("date").alias("day"), F.explode(F.from_json("sources", schema)).alias("s"))
    return rows.groupBy("day").agg(F.round(F.avg("s.score"), 6).alias("mean"), F.countDistinct("id").alias("answers"))


def weak_answers(answers: DataFrame, least: float = 0.3, n: int = 20, schema: str = "array<struct<score: double>>") -> DataFrame:
    """(id, mean): the answers of lowest mean score below `least`."""
    rows = answers.select("id", F.explode(F.from_json("sources", schema)).alias("s")).groupBy("id").agg(F.round(F.avg("s.score"), 6).alias("mean"))
    return rows.where(F.col("mean") < least).orderBy("mean", "id").limit(n)
