"""The near_dedup stage against brute force on five-word shingles."""

from __future__ import annotations

import random

import corpus_pipeline
from quillspark.llm import shingle_sets


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute_kept(texts):
    sets = {d: shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d for d in texts if top(d) == d}


def test_near_dedup_stage_finds_every_pair(spark):
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(40))
    texts = {}
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([7, 60, 200, 600]))]
        for edits in (0, 1, 2, 4, 9):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(copy) + (" " + line if g % 3 == 0 else "")
    # at the bound: 12 of 15 shingles shared is 0.8, 11 of 15 is less
    texts |= {1000: " ".join(f"a{i}" for i in range(19)), 1001: " ".join(f"a{i}" for i in range(16)), 1002: " ".join(f"b{i}" for i in range(19)), 1003: " ".join(f"b{i}" for i in range(15))}
    rows = [(d, t, "x", "y", len(t)) for d, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == brute_kept(texts)
    assert 1001 not in kept and 1003 in kept
    odd = spark.createDataFrame([(1, None, "x", "y", 0), (2, " ", "x", "y", 1), (None, "no id", "x", "y", 5), (3, "no id", "x", "y", 5), (3, "no id", "x", "y", 5)], docs.schema)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, odd, "").collect()) == [1, 3]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stage_takes_its_pairs_from_the_byte_position_index_first(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(800)) for _ in range(6)]
    texts += [texts[0] + " more", texts[1] + " words", texts[2] + " here"]
    docs = spark.createDataFrame([(d, t, "x", "y", len(t)) for d, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    found, whole = [], shingle_sets.simhash_components

    def seen(*given):
        found.append(whole(*given))
        return found[-1]

    monkeypatch.setattr(shingle_sets, "simhash_components", seen)
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == set(range(6))
    assert found[0].where("node <> component").count() == 3
