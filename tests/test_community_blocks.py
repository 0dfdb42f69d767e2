"""Local moves over blocks of links: the same communities however the links are dealt."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import communities


def test_hash_is_sparks(spark):
    rng = random.Random(2)
    x = [0, 1, -1, 2**63 - 1, -(2**63), *(rng.randrange(-(2**63), 2**63) for _ in range(50))]
    rows = spark.createDataFrame([(n, half) for n in x for half in (0, 7)], "node long, half long")
    for r in rows.select("node", "half", F.xxhash64("node", "half").alias("h")).collect():
        assert communities.xxhash64_longs(np.array([r.half]), communities.xxhash64_longs(np.array([r.node]), 42))[0] == r.h


@pytest.mark.parametrize("only_gains, pairs", [(True, None), (False, 2)])
def test_blocks_change_nothing(spark, only_gains, pairs):
    rng = random.Random(7)
    edges = [(g, rng.randrange(8) * 10 + rng.randrange(10), 0, 1.0 + rng.randrange(3)) for g in ("a", "b", None) for _ in range(150)]
    edges = [(g, u, u // 10 * 10 + rng.randrange(10) if rng.random() < 0.9 else rng.randrange(80), w) for g, u, _, w in edges]
    edges += [("hub", 0, n, 1.0) for n in range(1, 120)]
    links = communities.both_ways(spark.createDataFrame(edges, "graph string, src long, dst long, weight double"))
    found = [{(r.graph, r.node): r.community for r in communities.local_moves(links, 1.0, only_gains, pairs, block_links=n).collect()} for n in (100_000, 40)]
    assert found[0] == found[1] and {g for g, _ in found[0]} == {"a", "b", "hub"}
    assert len({c for (g, _), c in found[0].items() if g != "hub"}) < 80
