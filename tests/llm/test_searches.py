"""Vector searches against brute force: repeated ids, ties, clusters, large values."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quillspark.llm import ann, va_file

FIELDS = "vec_id long, embedding array<double>"


def brute(rows, every, k, score):
    out = {}
    rows = sorted({(i, tuple(v)) for i, v in rows})
    for qi, q in rows:
        if qi % every == 0:
            best = sorted(((-score(q, v), i) for i, v in rows if (i, v) != (qi, q) and len(v) == len(q)))[:k]
            out.setdefault(qi, []).append([(i, -s) for s, i in best])
    return {q: sorted(x) for q, x in out.items()}


def found(df):
    out, at = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def cosine(a, b):
    return float(ann.cosines(np.array(a), np.array([b]))[0])


def whole(a, b):
    return sum(int(np.floor(256 * x)) * int(np.floor(256 * y)) for x, y in zip(a, b, strict=True))


ROWS = [(0, [1.0, 0.0]), (7, [1.0, 0.1]), (9, [1.0, 0.1]), (7, [-1.0, 0.2]), (11, [-1.0, 0.2]), (12, [2.0, 0.2]), (3, [0.0, 1.0])]


@pytest.mark.parametrize(("search", "score"), [(ann.search, cosine), (va_file.search, whole)])
def test_ids_with_several_vectors(spark, search, score):
    got = found(search(spark.createDataFrame(ROWS, FIELDS), every=50, k=6))
    want = brute(ROWS, 50, 6, score)
    assert [i for i, _ in got[0]] == [i for i, _ in want[0][0]] and np.allclose([s for _, s in got[0]], [s for _, s in want[0][0]])


def test_large_products_are_exact(spark):
    rows = [(0, [1e6, 999999.5]), (1, [1000000.25, 3.0]), (2, [-5.0, 1e6]), (3, [1e6, 999999.5])]
    assert found(va_file.search(spark.createDataFrame(rows, FIELDS), every=50, k=3)) == {q: x[0] for q, x in brute(rows, 50, 3, whole).items()}


def test_far_values_change_nothing(spark):
    rng = np.random.default_rng(1)
    rows = [(i, x) for i, x in enumerate(rng.normal(size=(400, 6)).tolist())] + [(401, [1e5] * 6), (402, [-1e5] * 6)]
    assert found(va_file.search(spark.createDataFrame(rows, FIELDS), every=50, k=5)) == {q: x[0] for q, x in brute(rows, 50, 5, whole).items()}


def recall(got, ids, x, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        score = unit @ unit[ids == q][0]
        score[ids == q] = -9
        hits, total = hits + len({i for i, _ in got.get(q, [])} & set(ids[np.lexsort((ids, -score))[:k]].tolist())), total + k
    return hits / total


def test_recall_at_a_larger_scale(spark):
    place = "/root/testdata/sf0.1/embeddings.parquet"
    rows = duckdb.execute(f"SELECT vec_id, embedding FROM '{place}'").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    got = found(ann.search(spark.read.parquet(place), every=50, k=5))
    assert all(len(v) == 5 for v in got.values()) and recall(got, ids, x, 5) >= 0.9


def test_recall_beside_tight_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 32))
    x = np.concatenate([np.repeat(centres, 60, axis=0) + 0.02 * rng.normal(size=(1800, 32)), rng.normal(size=(1200, 32))])
    ids = rng.permutation(3000)
    got = found(ann.search(spark.createDataFrame(list(zip(ids.tolist(), x.tolist(), strict=True)), FIELDS), every=50, k=5))
    assert recall(got, ids, x, 5) >= 0.9
