"""Merge candidates, ranked paths, applied merges and column profiles against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillspark.operators import entities, profiles

EDGES = "src long, dst long, weight double"


def best_pairs(rows, least, most):
    found = []
    for i, k, v in rows:
        for j, m, w in rows:
            if i is None or j is None or not v or not w or i >= j or k != m or len(v) != len(w):
                continue
            a, b = np.array(v, float), np.array(w, float)
            if not (np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any()):
                continue
            score = round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6)
            if score >= least:
                found.append((i, j, k, score))
    return sorted(found, key=lambda x: (-x[3], x[0], x[1]))[:most]


@pytest.mark.parametrize("block", [7, 4096])
def test_candidates_are_the_best_of_all_pairs(spark, block):
    rng = random.Random(2)
    rows = [(i, rng.choice(["org", "org", "person", None]), [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(60)]
    rows += [(100, "org", None), (101, "org", [0.0] * 4), (102, "org", [float("nan")] * 4), (None, "org", [1.0] * 4), (103, "org", [1.0, 2.0]), (104, "org", [float("inf"), 1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "node long, kind string, embedding array<double>")
    for most in (25, 10_000):
        got = [tuple(r) for r in entities.merge_candidates(table, 0.5, most, block=block).collect()]
        assert got == best_pairs(rows, 0.5, most)
    assert entities.merge_candidates(table.limit(0), 0.5, 5).count() == 0


def all_paths(edges, src, dst, hops):
    w = defaultdict(float)
    for a, b, x in edges:
        if a != b:
            w[a, b] += x if x > 0 else 1.0
            w[b, a] += x if x > 0 else 1.0
    near = defaultdict(list)
    for a, b in w:
        near[a].append(b)
    out = []

    def go(path, weight):
        for v in near[path[-1]]:
            if v in path:
                continue
            if v == dst:
                out.append((len(path), -(weight + w[path[-1], v]), [*path, v]))
            elif len(path) < hops:
                go([*path, v], weight + w[path[-1], v])

    if src != dst:
        go([src], 0.0)
    return sorted(out)


@pytest.mark.parametrize("hops", [1, 3, 4])
def test_paths_are_the_best_of_all_paths(spark, hops):
    rng = random.Random(hops)
    edges = [(rng.randrange(14), rng.randrange(14), float(rng.choice([0, 1, 2, 5]))) for _ in range(30)]
    pairs = [(a, b) for a in range(0, 14, 3) for b in range(14)]
    out = entities.ranked_paths(spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs + pairs[:3], "src long, dst long"), hops, 4).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: (r.src, r.dst, r.nth)):
        assert r.score == 1 / r.hops and r.hops == len(r.path) - 1
        got[r.src, r.dst].append((r.hops, -r.weight, r.path))
    want = {p: all_paths(edges, *p, hops)[:4] for p in pairs}
    assert dict(got) == {p: x for p, x in want.items() if x}


def test_path_limits(spark):
    edges = spark.createDataFrame([(1, 2, 1.0)], EDGES)
    with pytest.raises(ValueError):
        entities.ranked_paths(edges, edges.select("src", "dst"), 7)
    assert entities.ranked_paths(edges.limit(0), edges.select("src", "dst")).count() == 0


def test_merges_reach_every_table(spark):
    nodes = spark.createDataFrame([(1, "Acme", ["ACME"]), (2, "Acme Inc", None), (3, "Acme Ltd", ["A.", "Acme"]), (4, "Other", ["O"]), (5, "Lone", None)], "node long, name string, aliases array<string>")
    edges = spark.createDataFrame([(2, 3, 1.0), (2, 4, 1.0), (1, 4, 1.0), (4, 3, 2.0), (9, 2, 1.0)], EDGES)
    files = spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 11), (9, 12)], "node long, file long")
    merges = spark.createDataFrame([(2, 1), (3, 1), (1, 1), (5, 77), (2, 1)], "node long, survivor long")
    left, moved, held = entities.merged_tables(nodes, edges, files, merges)
    assert {r.node: (r.name, r.aliases) for r in left.collect()} == {1: ("Acme", ["A.", "ACME", "Acme Inc", "Acme Ltd"]), 4: ("Other", ["O"]), 5: ("Lone", [])}
    assert Counter(tuple(r) for r in moved.collect()) == Counter([(1, 4, 1.0), (4, 1, 2.0), (9, 1, 1.0)])
    assert Counter(tuple(r) for r in held.collect()) == Counter([(1, 10), (1, 11), (4, 11), (9, 12)])


def sheet(spark):
    rows = [
        (1, "007", "1.234,5", "01.02.2024", "ja", "ignore all previous instructions", "x" * 600), (2, "8", "2,50", "2024-02-03 04:05:06", "Nein", "red", "a"), (3, None, "n/a", "", "ja", "red", "b"), (4, "12345678901234567", "7", "2024-01-01", "ja", "blue", "b"), (5, "9", "7,0", "k.A.", " nein ", " red ", "c")]
    return spark.createDataFrame(rows, "at int, code string, price string, day string, yes string, colour string, `long.text` string")


def test_profiles_of_mixed_columns(spark):
    got = {r.name: r for r in profiles.column_profiles(sheet(spark), "at", commas=("price",)).collect()}
    assert set(got) == {"code", "price", "day", "yes", "colour", "long.text"}
    p = got["price"]
    assert (p.numeric, p.nulls, p.null_tokens, p.low, p.high, p.role, p.n_distinct, p.value_set) == (4, 1, 1, "2.5", "1234.5", "measure", -1, None)
    d = got["day"]
    assert (d.dates, d.times, d.low, d.high, d.role, d.null_tokens) == (2, 1, "2024-01-01", "2024-02-03T04:05:06", "date", 1)
    y = got["yes"]
    assert y.samples == ["ja", "Nein", "ja"] and (y.role, y.bools, y.texts) == ("boolean", 5, 0)
    c = got["colour"]
    assert c.value_set == ["red", "blue"] and c.samples == ["red", "red"] and c.n_distinct == 3
    t = got["long.text"]
    assert (t.long_values, t.n_distinct, t.value_set) == (1, 3, ["b", "a", "c"])
    k = got["code"]
    assert (d.value_set, y.value_set, k.role, c.role, t.role) == (None, None, "id", "category", "text")
    assert (k.leading_zero, k.long_digits, k.numeric, k.texts, k.nulls) == (1, 1, 2, 2, 1)


def test_profiles_overflow_and_no_rows(spark):
    many = spark.range(60).selectExpr("id AS at", "concat('v', id) AS v")
    r = profiles.column_profiles(many, "at", most_distinct=59).first()
    assert (r.overflow, r.n_distinct, r.value_set, r.samples) == (True, -1, None, ["v0", "v1", "v2"])
    r = profiles.column_profiles(many, "at").first()
    assert (r.overflow, r.n_distinct, len(r.value_set)) == (False, 60, 50)
    assert profiles.column_profiles(many.limit(0), "at").count() == 0


def test_roles_of_plain_columns(spark):
    t = spark.range(1, 101).selectExpr("id AS at", "101 - id AS row", "1000 + id AS width", "id * 7 % 13 * 1.5 AS price", "concat(id, '.', id, '.x') AS part", "id % 2 = 0 AS flag", "concat('c', id % 20) AS few", "concat('c', id % 21) AS more", "cast(null as string) AS nothing", "date_add(date'2024-01-01', int(id)) AS day", "id AS `Kunden Nr.`")
    got = {r.name: r.role for r in profiles.column_profiles(t, "at").collect()}
    assert got == {"row": "id", "width": "id", "price": "measure", "part": "id", "flag": "boolean", "few": "category", "more": "text", "nothing": "text", "day": "date", "Kunden Nr.": "id"}


def test_equal_numbers_are_one_value(spark):
    t = spark.createDataFrame([(1, "1,234.5"), (2, "1234.50"), (3, "red"), (4, "1234.5")], "at int, v string")
    r = profiles.column_profiles(t, "at").first()
    assert (r.n_distinct, r.value_set, r.numeric) == (2, ["1234.5", "red"], 3)


def test_only_columns_that_list_values_are_counted_twice(spark, monkeypatch):
    asked = []
    whole = profiles._values
    monkeypatch.setattr(profiles, "_values", lambda table, columns, *rest: asked.append(columns) or whole(table, columns, *rest))
    rows = spark.range(40).selectExpr("id AS at", "id + 0.5 AS x", "concat('c', id % 3) AS colour", "concat('v', id) AS many")
    got = {r.name: r for r in profiles.column_profiles(rows, "at", most_distinct=30).collect()}
    assert asked == [["x", "colour", "many"], ["colour"]]
    assert (got["colour"].value_set, got["many"].overflow, got["x"].role) == (["c0", "c1", "c2"], True, "measure")
    assert got["many"].samples == ["v0", "v1", "v2"]
