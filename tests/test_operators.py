from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillspark.functions import cells
from quillspark.operators import chunks, evaluation, fusion, graph, rerank, tabular
from quillspark.operators.vector import cosine


def test_split_text_keeps_every_word_and_the_limit():
    text = "\n\n".join(" ".join(f"w{i}_{j}" for j in range(30)) for i in range(20))
    found = chunks.split_text(text, 40, 0)
    assert [w for c in found for w in c.split()] == text.split()
    assert all(len(c) <= 160 for c in found)


def test_split_text_overlaps_and_edges():
    text = " ".join(f"word{i}" for i in range(200))
    found = chunks.split_text(text, 20, 5)
    assert all(b.split()[0] in a.split() for a, b in zip(found, found[1:]))
    assert chunks.split_text("", 10, 2) == [] and chunks.split_text("  \n\n ", 10, 2) == []
    assert "".join(chunks.split_text("a" * 4096, 100, 0)) == "a" * 4096


def test_cells(spark):
    rows = spark.createDataFrame([("1,234.5",), ("007",), ("12.03.2024",), ("n/a",), ("-3",), ("1234567890123456",)], "c string")
    out = rows.select(cells.number(F.col("c")), cells.is_id_like(F.col("c")), cells.iso_date(F.col("c")).cast("string"), cells.is_blank(F.col("c"))).collect()
    assert [r[0] for r in out] == [1234.5, None, None, None, -3.0, None]
    assert [r[1] for r in out] == [False, True, True, False, False, True]  # digits with further segments are of that shape too
    assert out[2][2] == "2024-03-12" and [r[3] for r in out] == [False, False, False, True, False, False]


def test_column_types(spark):
    t = spark.createDataFrame([("1", "01", "2024-01-02", "ja", "x"), ("2", "02", "2024-01-03", "nein", "1"), (None, "03", "", "ja", "y")], "a string, b string, c string, d string, e string")
    kinds = {r.name: r.type for r in tabular.column_types(tabular.column_statistics(t)).collect()}
    assert kinds == {"a": "numeric", "b": "text", "c": "date", "d": "boolean", "e": "text"}


def test_rank_fusion_skips_lists_without_weight(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    out = {r.id: r.score for r in fusion.rank_fusion([(a, 1.0), (a, -1.0), (a, 0.5)]).collect()}
    assert out == {10: pytest.approx(1.5 / 61, abs=1e-6), 11: pytest.approx(1.5 / 62, abs=1e-6)}


def test_near_copies_go_within_their_group_only(spark):
    rows = spark.createDataFrame([(1, 1, "a", 1, "x y z", 3.0), (1, 2, "a", 2, "x y z", 2.0), (1, 3, "b", 3, "x y z", 1.0)], "query_id long, id long, group_id string, rank int, text string, score double")
    assert [r.id for r in rerank.without_near_copies(rows).orderBy("rank").collect()] == [1, 3]
    picks = [r.id for r in rerank.diversified(rows.withColumn("score", F.col("score") / 3), 2).orderBy("pick").collect()]
    assert picks[0] == 1 and len(picks) == 2


def test_budget_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([(1, 1, 3.0, 50, 2), (1, 2, 2.0, 60, 1), (1, 3, 1.0, 40, 3)], "query_id long, id long, score double, tokens long, pos int")
    assert [r.id for r in rerank.within_budget(rows, 95).collect()] == [1, 3]


def test_cosine_guards(spark):
    row = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [1.0])], "a array<double>, b array<double>, z array<double>, s array<double>")
    out = row.select(cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z")), cosine(F.col("a"), F.col("s"))).first()
    assert list(out) == [1.0, 0.0, 0.0]


def test_wilson_and_regressions(spark):
    low, high = evaluation.wilson(F.col("w"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (5, 10)], "w long, n long").select(low, high).collect()
    assert tuple(got[0]) == (0.0, 1.0) and got[1][0] == pytest.approx(0.2366, abs=1e-4)
    now = spark.createDataFrame([("a", 0.5, 0.9)], "route string, recall double, rr double")
    before = spark.createDataFrame([("a", 0.6, 0.9)], "route string, recall double, rr double")
    assert [tuple(r) for r in evaluation.regressions(now, before, "route", {"recall": 0.02, "rr": 0.03}).collect()] == [("a", "recall", -0.1)]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 0.0), (4, 5, 2.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1,)], "node long")
    scores = {r.node: r.score for r in graph.personalised_pagerank(edges, seeds).collect()}
    assert sum(scores.values()) == pytest.approx(1.0, abs=1e-6) and scores[1] > scores[2] and 4 not in scores
    paths = graph.simple_paths(edges, spark.createDataFrame([(1, 3)], "src long, dst long")).collect()
    assert sorted(r.path for r in paths) == [[1, 2, 3], [1, 3]]
    roots = {r.node: r.root for r in graph.merge_clusters(spark.createDataFrame([(3, 2), (2, 7), (8, 9)], "a long, b long")).collect()}
    assert roots == {2: 2, 3: 2, 7: 2, 8: 8, 9: 8}


def test_ranks_with_a_seed_that_has_no_edges(spark):
    edges = spark.createDataFrame([(1, 2, 2.0), (2, 3, 1.0), (3, 1, 0.0), (4, 4, 1.0)], "src long, dst long, weight double")
    seeds = spark.createDataFrame([(1,), (4,), (1,)], "node long")
    links = {1: {2: 2.0, 3: 1.0}, 2: {1: 2.0, 3: 1.0}, 3: {2: 1.0, 1: 1.0}}
    score = {1: 0.5, 4: 0.5}
    for _ in range(20):
        lost = score.get(4, 0.0)
        new = {n: 0.85 * sum(score.get(u, 0.0) * w[n] / sum(w.values()) for u, w in links.items() if n in w) for n in (1, 2, 3, 4)}
        for s in (1, 4):
            new[s] += 0.85 * 0.5 * lost + 0.15 * 0.5
        score = new
    found = {r.node: r.score for r in graph.personalised_pagerank(edges, seeds, tolerance=0.0).collect()}
    assert found.keys() == score.keys() and all(abs(found[n] - score[n]) < 1e-9 for n in score)
