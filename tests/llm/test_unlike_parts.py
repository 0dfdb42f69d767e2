"""What two lines don't share at their ends decides their edit distance."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.llm import line_dedup as L


def test_parts_keep_the_distance(spark):
    rng = random.Random(3)
    rows = [("a b c", "a c"), ("a", "a a"), ("a a", "a a a"), ("x", "y"), ("é b", "b"), ("same", "same")]
    for _ in range(60):
        w = [rng.choice(["a", "b", "ab", "ñu", "long"]) for _ in range(rng.randrange(1, 9))]
        v = [x for x in w if rng.random() > 0.2] or ["z"]
        v.insert(rng.randrange(len(v) + 1), rng.choice(["b", "q"]))
        rows.append((" ".join(w), " ".join(v)))
    rows.append(("word " * 500 + "one" + " tail" * 500, "word " * 500 + "two" + " tail" * 500))
    p = L.unlike_parts(F.col("a"), F.col("b"))
    table = spark.createDataFrame(rows, "a string, b string").withColumn("p", p)
    got = table.select("p", F.levenshtein("a", "b").alias("d"), F.levenshtein("p.a", "p.b").alias("d_parts"), L.apart_by_words(F.col("p.a"), F.col("p.b")).alias("most")).collect()
    assert all(r.d == r.d_parts <= r.most for r in got)
    assert (got[-1].p.a, got[-1].p.b) == ("one ", "two ") and got[-1].most == got[-1].d
