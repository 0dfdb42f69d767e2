"""Few rows are dealt out to find near fingerprints, none that has a near one is lost, and counters don't overflow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.llm import fingerprint_pairs as P
from quillspark.llm import line_dedup as L


def test_every_choice_of_blocks_has_its_stem():
    for n, most in ((6, 3), (8, 3), (10, 3), (16, 3), (4, 2), (2, 1)):
        stems, masks = P.stems_of(n, n - most, 60), P.block_masks(n, n - most, 60)
        assert all(any(m & s == s for s in stems) for m in masks)
    assert len(P.stems_of(6, 3, 60)) == 6 and len(P.block_masks(6, 3, 60)) == 20
    assert P.stem_blocks(2_000_000, 3, 60) == 6 < P.stem_blocks(117_000_000, 3, 60)


@pytest.mark.parametrize("searched", [4096, 64])
def test_rows_with_a_near_one_stay(spark, monkeypatch, searched):
    monkeypatch.setattr(P, "_SEARCHED", searched)
    rng = random.Random(5)
    prints = [rng.getrandbits(60) for _ in range(300)]
    prints += [p ^ sum(1 << b for b in rng.sample(range(60), k)) for p in prints[:120] for k in (rng.randint(1, 5),)]
    prints += prints[:7]
    prints += [rng.getrandbits(30) << 30 for _ in range(600)]  # one long list of a stem
    near = {i for i, a in enumerate(prints) if any(i != j and (a ^ b).bit_count() <= 3 for j, b in enumerate(prints))}
    got = [r.node for r in P.partnered(spark.createDataFrame(list(enumerate(prints)), "node long, fp long"), 3, 60).collect()]
    assert len(got) == len(set(got)) and near <= set(got)
    assert (set(got) == near) == (searched == 4096)


def test_counters_of_either_width_agree(spark):
    rng = random.Random(8)
    names = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(names) for _ in range(n)) for n in (1, 2, 3, 4, 50, 999)]
    texts += [" ".join(f"{i}" for i in range(n)) for n in (3000, 5000)] + [" ".join("abcdefghijklmnopqrstuvwxyz"[i % 26] for i in range(40_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = L.line_rows(docs, "doc_id", "text")
    fps = lambda rows: {(r.h1, r.fp) for r in rows.collect()}
    assert fps(L._counted(lines, 15)) == fps(L._counted(lines, 30)) == fps(L.line_classes(lines))
    assert len(fps(L.line_classes(lines))) == len(texts)
