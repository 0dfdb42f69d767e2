"""Nearest vectors by blocks against every pair, with odd rows."""

from __future__ import annotations

import math
import random

import pytest

from quillspark.operators import vector


def cosine(a, b):
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 0.0 if len(a) != len(b) or norms == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / norms


def brute(rows, asked, k):
    out = {}
    for i, a in asked:
        best = sorted((-round(cosine(a, b), 6), j) for j, b in rows if j != i)[:k]
        out |= {(i, j): (n, -s) for n, (s, j) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize("block", [7, 8192])
def test_blocks_find_what_all_pairs_find(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(150)]
    rows += [(i, rows[i % 3][1]) for i in range(150, 190)] + [(190, [0.0] * 5), (191, [1.0, 2.0]), (192, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector.cosine_top_k(df, df.where("vec_id % 10 = 0 OR vec_id > 189"), 6, block=block)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r.query_id, r.id): (r["rank"], r.score) for r in found.collect()}
    want = brute(rows, [r for r in rows if r[0] % 10 == 0 or r[0] > 189], 6)
    assert got.keys() == want.keys() and all(got[x][0] == want[x][0] and got[x][1] == pytest.approx(want[x][1], abs=1e-9) for x in want)


def test_vectors_without_a_cosine_stay_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = vector.cosine_top_k(df, df.where("vec_id = 0"), 9).collect()
    assert sorted((r.id, r.score is None) for r in found) == [(1, False), (2, True), (3, True), (4, False)]
    assert {r.id for r in found if r["rank"] > 2} == {2, 3}
