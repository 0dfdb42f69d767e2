"""Sums whose tasks hold a bounded number of keys, whatever the input split's size."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph


def test_ends_are_dealt_out_before_they_are_summed(spark, monkeypatch):
    edges = spark.range(2000).select((F.col("id") % 7).alias("src"), (100 + F.col("id") % 900).alias("dst"), (F.col("id") % 400).alias("chunk")).cache()
    rows = edges.collect()
    degree, score = {}, {}
    for r in rows:
        for node in (r.src, r.dst):
            degree[node] = degree.get(node, 0) + 1
    for r in rows:
        score[r.chunk] = score.get(r.chunk, 0) + sum(1 if n in (1, 2) else degree[n] for n in (r.src, r.dst))
    monkeypatch.setattr(graph, "_ROWS", 100)
    found = graph.degrees(edges)
    assert found.rdd.getNumPartitions() == 40  # 4000 ends, 100 a task
    assert {r.node: r.degree for r in found.collect()} == degree
    chunks = graph.chunk_scores(edges, found.select("node", F.col("degree").cast("double").alias("score")), spark.createDataFrame([(1,), (2,)], "node long"))
    assert chunks.rdd.getNumPartitions() == 40
    assert {r.chunk: r.score for r in chunks.collect()} == score
