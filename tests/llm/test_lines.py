"""Fuzzy line de-duplication against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import line_dedup as L

SF = "/root/testdata/sf0.001"


def distance(a, b):
    """Edit distance, a row at a time."""
    x, row = np.array([ord(c) for c in b]), np.arange(len(b) + 1)
    for i, c in enumerate(a, start=1):
        step = np.minimum(row[1:] + 1, row[:-1] + (x != ord(c)))
        new = np.concatenate(([i], step))
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return int(row[-1])


def norm(line):
    return re.sub(r"[^\w]+|_+", " ", line.lower()).strip()


def brute(docs, prints, most_bits=3, least=0.8):
    """doc -> positions of the lines that go."""
    lines = [(d, p, norm(x)) for d, t in docs.items() for p, x in enumerate((t or "").split("\n")) if norm(x)]
    kinds = sorted({n for _, _, n in lines})
    root = {n: n for n in kinds}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    fp = np.array([prints[n] for n in kinds], dtype=np.int64)
    for i, n in enumerate(kinds):
        for j in np.flatnonzero(np.bitwise_count(fp[:i] ^ fp[i]) <= most_bits):
            m = kinds[j]
            longer = max(len(m), len(n))
            if abs(len(m) - len(n)) <= longer * (1 - least) + 1e-9 and distance(m, n) <= int(longer * (1 - least) + 1e-9):
                root[max(top(m), top(n))] = min(top(m), top(n))
    groups = defaultdict(list)
    for d, p, n in lines:
        groups[top(n)].append((d, p))
    gone = defaultdict(set)
    for g in groups.values():
        for d, p in sorted(g)[1:]:
            gone[d].add(p)
    return gone


def prints_of(spark, lines):
    return {r.norm: r.fp for r in lines.join(L.line_classes(lines), ["h1", "h2"]).select("norm", "fp").distinct().collect()}


def test_documents_against_all_pairs(spark):
    docs = dict(duckdb.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    table = spark.read.parquet(f"{SF}/documents.parquet")
    prints = prints_of(spark, L.line_rows(table, "doc_id", "text"))
    gone = brute(docs, prints)
    for r in L.dedup_lines(table).collect():
        want = [x for p, x in enumerate(docs[r.doc_id].split("\n")) if p not in gone[r.doc_id]]
        assert r.text == "\n".join(want) and r.n_removed == len(gone[r.doc_id])


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def pairs():
    """Lines and copies with small changes, on both sides of every length that the operator treats in its own way."""
    rng = random.Random(4)
    out = []
    for n in (3, 12, 13, 14, 15, 40, 150, 160, 170, 400, 1100, 1500):
        for change in ("letter", "insert", "drop", "tail"):
            w = words(rng, n)
            v, at = list(w), rng.randrange(n)
            if change == "letter":
                v[at] = v[at][:-1] + "z"
            elif change == "insert":
                v.insert(at, "extra")
            elif change == "drop":
                del v[at]
            else:
                v[-1] += "s"
            out.append((" ".join(w), " ".join(v)))
    return out


def test_pairs_of_every_length(spark):
    docs = {}
    for i, (a, b) in enumerate(pairs()):
        docs[2 * i], docs[2 * i + 1] = a, b
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    gone = brute(docs, prints_of(spark, L.line_rows(table, "doc_id", "text")))
    got = {r.doc_id: r.n_removed for r in L.dedup_lines(table).collect()}
    assert got == {d: len(gone[d]) for d in docs} and sum(got.values()) >= 20
    assert {len(docs[d]) > 1000 for d, n in got.items() if n} == {True, False}


@pytest.mark.parametrize("least", [0.8, 0.95])
def test_similarity_is_edit_similarity(spark, least):
    rng = random.Random(9)
    rows = pairs() + [(a, c) for (a, _), (_, c) in zip(pairs(), pairs()[1:])]
    for n in (200, 400):
        w = words(rng, n)
        rows += [(" ".join(w), " ".join(w[k:] + words(rng, k))) for k in (5, 20, 60)] + [(" ".join(w), " ".join(x if rng.random() > share else "qqq" for x in w)) for share in (0.05, 0.15, 0.3)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", L.similar(F.col("a"), F.col("b"), least).alias("s")).collect()
    for r in got:
        longer = max(len(r.a), len(r.b))
        if abs(len(r.a) - len(r.b)) > longer * (1 - least) + 1e-9:
            assert not r.s
        else:
            assert r.s == (distance(r.a, r.b) <= int(longer * (1 - least) + 1e-9))


def test_rows_without_ids_and_ties(spark):
    rows = [(None, "same line\nfirst"), (None, "same line\nsecond"), (None, "same line\nsame line"), (None, None), (None, "")]
    out = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum((r.text or "").split("\n").count("same line") for r in out) == 1 and sum(r.n_removed for r in out) == 3
    assert [r.text for r in out].count(None) == 1
