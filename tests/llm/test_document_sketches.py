from __future__ import annotations

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import document_sketches as ds
from quillspark.llm import queries as registered

LIMIT = -(1 << 63) + (1 << 61)


def shingles(text, width=5):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text.lower()).split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def hashed(shingle):
    """A hash chained over words, each seeded with the one before."""
    h = 42
    for w in shingle:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def sketch(text):
    every = sorted(map(hashed, shingles(text)))
    below = [h for h in every if h < LIMIT]
    return below if len(below) >= 16 else every[:16]


def likeness(a, b):
    if a == b:
        return 1.0
    to = min((1 << 63) - 1 if len(s) < 16 else max(s[-1], LIMIT - 1) for s in (a, b))
    x, y = ({h for h in s if h <= to} for s in (a, b))
    return len(x & y) / min(len(x), len(y)) if x and y else 0.0


def brute(docs):
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    out = []
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        mine, new, next_ = sketch(t), sketch(edited), sketch(after)
        show = lambda s: "".join(f"{h % (1 << 64):016x}" for h in s)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), show(mine), show(new), likeness(mine, new), likeness(mine, next_)))
    return sorted(out, key=repr)


def test_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    out = registered.op13_threshold_sketches(spark, "/root/testdata/sf0.01")
    want = brute(docs)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    of, ids = dict(docs), sorted((d for d, _ in docs), reverse=True)
    apart = [r for r in want if len(shingles(of[r[0]])) >= 12 and of[r[0]] != of[ids[(ids.index(r[0]) + 1) % len(ids)]]]
    assert len(apart) > 800 and sum(r[5] > r[6] for r in apart) / len(apart) > 0.98


def test_estimates_follow_the_shingles(spark):
    """Against the exact share of shingles, on texts of very unequal length."""
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(5000)]
    long = " ".join(rng.choices(pool, k=20_000))
    cut = long.split()
    pairs = [(long, " ".join(cut[i : i + n] + rng.choices(pool, k=m))) for i, n, m in ((0, 2000, 0), (5000, 1500, 1500), (0, 100, 300), (100, 15_000, 4000), (7, 40, 0))]
    df = ds.sketched(ds.sketched(spark.createDataFrame(pairs, "a string, b string"), "a", "x", 5, 1 / 8, 16), "b", "y", 5, 1 / 8, 16)
    for r in df.select("a", "b", ds.containment(F.col("x"), F.col("y"), 1 / 8, 16).alias("near"), ds.merge(F.col("x"), F.col("y"), 1 / 8, 16).alias("both")).collect():
        a, b = shingles(r.a), shingles(r.b)
        assert abs(r.near - len(a & b) / min(len(a), len(b))) < 0.12
        every = sorted(map(hashed, a | b))
        assert r.both == [h for h in every if h < LIMIT]


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_odd_rows(spark, parts):
    texts = [None, "", " \n", "one", "Two words", "a b c d e", "A B  C\td\ne", "é" * 9, "same text of a few words here " * 40, "日本 語 " * 30_000, "x" * 300_000]
    docs = [(i * i, t) for i, t in enumerate(texts)] + [(4, "same id")] * 3 + [(4, "other"), (None, "no id"), (None, None), (-5, "neg")]
    df = spark.createDataFrame([(d, t, "a", 1) for d, t in docs], "doc_id long, text string, part string, sketch int")
    out = ds.compare_edited(df, parts=parts)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == brute(docs)


def test_one_row_and_no_row(spark):
    one = spark.createDataFrame([(3, "just one row of text")], "doc_id long, text string")
    assert [tuple(r) for r in ds.compare_edited(one).collect()] == brute([(3, "just one row of text")])
    assert ds.compare_edited(one.limit(0)).count() == 0
