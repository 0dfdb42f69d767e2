from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import importance_resampling as ir
from quillspark.llm import queries as registered

LOWER = {x: x + 32 for x in range(65, 91)}


def features(text, width=1, buckets=10_000):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(docs, target, width=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    source = Counter(b for _, t in docs for b in features(t, width, buckets)[1])
    wanted = Counter(b for t in target for b in features(t, width, buckets)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + buckets) / ((n + 1.0) * (t_all + buckets)))) for b, n in source.items()}
    rows = []
    for d, t in docs:
        n, mine = features(t, width, buckets)
        weight = sum(gain[b] for b in mine) // len(mine) if mine else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(mine), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(([*r[:4], drawn.get(id(r))] for r in rows), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"/root/testdata/{sf}/benchmark.parquet").collect()]
    out = registered.op12_importance_resampling(spark, f"/root/testdata/{sf}")
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((list(r) for r in out.collect()), key=repr) == brute(docs, target)


def test_odd_rows_and_word_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["Haus", "haus", "a1", "ÄRGER", "ärger", "x-y", "日本", "don't", " "]
    texts = [None, "", " .,;\n", "one", "日本語 " * 50_000, *(" ".join(rng.choices(vocabulary, k=rng.randrange(40))) for _ in range(60))]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 30 + [(None, texts[8])] * 3
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, score string, n long")
    target = spark.createDataFrame([("haus A1 日本",), (None,), ("",)], "text string")
    for width, buckets in ((1, 10_000), (3, 64)):
        out = ir.resample(df, target, width=width, buckets=buckets, percent=30, least_words=3)
        assert sorted((list(r) for r in out.collect()), key=repr) == brute(docs, ["haus A1 日本"], width, buckets, 30, 3)


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ir.resample(empty, some).count() == 0
    assert [tuple(r) for r in ir.resample(some, empty, percent=100, least_words=1).collect()] == [tuple(brute([(1, "a b c")], [], percent=100, least_words=1)[0])]
