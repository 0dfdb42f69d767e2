"""Communities' disk: tables and shuffles of a step go before the next one, and packed columns are small."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import communities
from quillspark.operators.scratch import Rounds


@pytest.fixture
def held(monkeypatch):
    """How many tables were in the folder after each one was written."""
    seen, keep = [], Rounds.keep

    def kept(self, df, *args, **named):
        out = keep(self, df, *args, **named)
        seen.append(len(os.listdir(urlparse(self.root).path)))
        return out

    monkeypatch.setattr(Rounds, "keep", kept)
    return seen


def path(spark, n):
    return spark.createDataFrame([(0, i, i + 1, 1.0) for i in range(n)], "graph int, src long, dst long, weight double")


def test_a_half_round_leaves_its_last_table_only(spark, held):
    found = communities.detect(path(spark, 60)).collect()
    assert len(held) > 8 and max(held) <= 5
    assert len(found) == 61 and len({r.community for r in found}) < 31


def test_a_summary_leaves_few_tables(spark, held):
    edges = path(spark, 6)
    of = spark.createDataFrame([(0, i // 4 * 4, i) for i in range(7)], "graph int, community long, node long")
    names = spark.createDataFrame([(0, i, f"n{i}") for i in range(7) if i != 2], "graph int, node long, name string")
    out = {r.community: (r.members, r.relations) for r in communities.summary_input(of, edges, names, 2, 5).collect()}
    assert out == {0: (["n1", "n0"], ["n0 - n1"]), 4: (["n5", "n4"], ["n4 - n5", "n5 - n6"])}
    assert 1 < max(held) <= 5


def test_packed_columns_are_small_and_come_back():
    rng = np.random.default_rng(3)
    for kind, types in communities._TYPES.items():
        for n in (0, 1, 5000):
            columns = [rng.integers(0, 2 if t == "?" else 100_000, n).astype(t) for t in types]
            for nth, x in enumerate(columns):
                b = communities._compressed(x, kind, nth)
                got = communities._expanded(pa.py_buffer(b), kind, nth)
                assert got.dtype == x.dtype and (got == x).all()
                assert n < 5000 or x.dtype.itemsize < 8 or len(b) < 0.6 * x.nbytes
    far = np.array([2**63 - 1, -(2**63), 0, 7], np.int64)
    assert (communities._expanded(pa.py_buffer(communities._compressed(far, communities._STATE, 1)), communities._STATE, 1) == far).all()


def test_shuffles_go_with_the_query_that_made_them(spark):
    def files():
        local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return local.getAllBlocks().mkString("\n").count("shuffle_")

    with Rounds(spark) as rounds:
        before = files()
        kept = rounds.keep(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
        assert files() <= before and kept.count() == 7


def test_packed_results_outlive_their_rounds(spark):
    with Rounds(spark) as rounds:
        out = rounds.result(spark.sql("SELECT * FROM VALUES (1, array('a', NULL), 'x'), (2, NULL, NULL) AS t(a, b, c)"), packed=True)
    assert sorted(map(tuple, out.collect())) == [(1, ["a", None], "x"), (2, None, None)]
