"""Merging of all vectors at a cosine, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from quillspark.operators import graph, vector
from quillspark.plans import analytics


def brute(ids, x, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = set()
    for i, row in enumerate(np.round(unit @ unit.T, 6) >= least):
        for j in np.flatnonzero(row):
            if i != j:
                linked |= {ids[i], ids[j]}
                a, b = sorted((top(ids[i]), top(ids[j])))
                root[b] = a
    return {i: top(i) for i in linked}


def table(spark, ids, x):
    return spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "vec_id long, embedding array<float>")


@pytest.mark.parametrize("block", [40, 8192])
def test_every_link_counts(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([np.repeat(centres, 15, axis=0) + 0.1 * rng.standard_normal((180, 16)), rng.standard_normal((20, 16))])
    x = x.astype(np.float32).astype(float)
    ids = [int(i) for i in rng.permutation(np.arange(1, 1001)[np.arange(1, 1001) % 50 != 0])[:200]]
    rows = table(spark, ids, x).union(spark.createDataFrame([(2001, None), (2002, [0.0] * 16), (None, [1.0] * 16), (2003, [float("nan")] * 16), (2004, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    got = {r.node: r.root for r in graph.merge_clusters(vector.similarity_links(rows, 0.8, block=block)).collect()}
    assert got == brute(ids, x, 0.8)


def test_the_query_takes_every_vector(spark, tmp_path):
    ids, x = [1, 2, 3, 4, 5], np.array([[1.0, 0, 0], [1, 0.1, 0], [0, 1, 0], [0, 0, -1], [0, 1, 0.2]])
    table(spark, ids, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.node: r.root for r in analytics.merged_entities(spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3, 5: 3}
    table(spark, [], np.zeros((0, 3))).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert analytics.merged_entities(spark, f"{tmp_path}/none").count() == 0
