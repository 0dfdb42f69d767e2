"""Streams of events: windows and first occurrences."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) over event time; rows later than `late` are dropped by a stream."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    of = F.window("at", width, slide) if slide else F.window("at", width)
    out = timed.groupBy(of.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, n): events of a user without a pause of `gap`."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    out = timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def first_seen(items: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Feed items whose key wasn't seen within `late`."""
    return items.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def drained(spark: SparkSession, stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what its source holds now, and gives the result as a table.

    Its checkpoint is in the shared folder; the result is written there too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_streams"
    place = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/result")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/result")
