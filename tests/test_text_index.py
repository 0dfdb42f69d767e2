"""The stored index against plain recomputation after several batches."""

from __future__ import annotations

import datetime
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.functions import questions
from quillspark.operators import text_index

CHANGES = "corpus string, id long, text string, deleted boolean, at timestamp"
WORDS = "alpha beta gamma delta epsilon x1 Über 日本".split()


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    rng, at = random.Random(8), datetime.datetime(2024, 1, 1)
    index, state, batches = text_index.TextIndex(spark, str(tmp_path_factory.mktemp("index"))), {}, []
    for _ in range(4):
        changes = []
        for _ in range(60):
            at += datetime.timedelta(minutes=1)
            key, gone = (rng.choice("AB"), rng.randrange(40)), rng.random() < 0.2
            text = rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randrange(25)))])
            changes.append((*key, text, gone, at))
            state.pop(key, None)
            if not gone:
                state[key] = text
        changes += [(None, 1, "lost", False, at), ("A", None, "lost", False, at)]
        batches.append(changes)
    for n, changes in enumerate(batches):
        index.apply(n, spark.createDataFrame(changes, CHANGES))
    index.apply(3, spark.createDataFrame(batches[3], CHANGES))  # again, as after a failure
    return index, state, at


def recomputed(state):
    terms, sizes = Counter(), defaultdict(list)
    for (c, _), text in state.items():
        sizes[c].append(len(set(words(text))))
        terms.update((c, w) for w in set(words(text)))
    return dict(terms), {c: (len(x), sum(x) / len(x)) for c, x in sizes.items()}


def test_statistics_equal_recomputation(spark, filled, tmp_path):
    index, state, at = filled
    terms, sizes = recomputed(state)
    for which in (index, index.compacted(str(tmp_path / "one"))):
        assert {(r.corpus, r.lexeme): r.df for r in which.terms().collect()} == terms
        assert {r.corpus: (r.n, pytest.approx(r.avgdl)) for r in which.sizes().collect()} == sizes
        assert which.sizes().agg(F.max("at")).first()[0] == at
        got = {(r.corpus, r.id, r.lexeme): (r.tf, r.dl, list(r.positions)) for r in which.postings().collect()}
        want = {(c, i, w): (words(t).count(w), len(set(words(t))), [n for n, x in enumerate(words(t)) if x == w]) for (c, i), t in state.items() for w in set(words(t))}
        assert got == want
    assert index.compacted(str(tmp_path / "two")).table("versions").where("batch >= 0").count() == len(state)


def best(state, asked, k=10):
    """asked: (corpus, phrases, loose words)."""
    terms, sizes = recomputed(state)
    corpus, phrases, loose = asked
    out = []
    for (c, i), text in state.items():
        w = words(text)
        parts = [any(w[n : n + len(p)] == p for n in range(len(w))) for p in phrases] + ([any(x in w for x in loose)] if loose else [])
        if c == corpus and parts and all(parts):
            n, avg = sizes[c]
            score = 0.0
            for x in {*loose, *(x for p in phrases for x in p)} & set(w):
                idf = math.log((n - terms[c, x] + 0.5) / (terms[c, x] + 0.5) + 1)
                score += idf * w.count(x) * 2.2 / (w.count(x) + 1.2 * (0.25 + 0.75 * len(set(w)) / avg))
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_search(spark, filled):
    index, state, _ = filled
    queries = [(0, "A", "alpha 日本"), (1, "A", '"alpha beta" gamma'), (2, "B", 'x1 "über delta" “gamma gamma”'), (3, "B", '"alpha beta gamma"'), (4, "A", "?!"), (5, None, "alpha"), (6, "C", "alpha"), (7, "A", '"beta" "gamma"'), (8, "A", None)]
    asked = {0: ("A", [], ["alpha", "日本"]), 1: ("A", [["alpha", "beta"]], ["gamma"]), 2: ("B", [["über", "delta"], ["gamma", "gamma"]], ["x1"]), 3: ("B", [["alpha", "beta", "gamma"]], []), 7: ("A", [["beta"], ["gamma"]], [])}
    out = defaultdict(list)
    for r in text_index.search(index, spark.createDataFrame(queries, "query_id long, corpus string, text string")).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.id, pytest.approx(r.score, abs=2e-6)))
    want = {q: best(state, a) for q, a in asked.items()}
    assert all(want[q] for q in (0, 1, 7))
    assert dict(out) == {q: rows for q, rows in want.items() if rows}


def test_stale(spark):
    t = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    newest = spark.createDataFrame([("new", t(50)), ("fresh", t(10)), ("behind", t(40)), ("aged", t(1)), ("busy", t(60))], "corpus string, newest timestamp")
    sizes = spark.createDataFrame([("fresh", 1, 1.0, t(30)), ("behind", 1, 1.0, t(39)), ("aged", 1, 1.0, t(5)), ("busy", 1, 1.0, t(1))], "corpus string, n long, avgdl double, at timestamp")
    busy = spark.createDataFrame([("busy",)], "corpus string")
    assert [r.corpus for r in text_index.stale(newest, sizes, "2024-01-02 12:00:00", 24.0, busy).collect()] == ["new", "behind", "aged"]


def test_followed_stream(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    for n, rows in enumerate([[("A", 1, "one two", False, at), ("A", 2, "two", False, at)], [("A", 1, None, True, at)]]):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))
    index = text_index.TextIndex(spark, str(tmp_path / "index"))
    for n in range(2):
        stream = spark.readStream.schema(CHANGES).parquet(str(tmp_path / f"in/{n}"))
        if n == 0:
            index.follow(stream, str(tmp_path / "state")).awaitTermination()
        else:
            index.apply(1, spark.read.schema(CHANGES).parquet(str(tmp_path / f"in/{n}")))
    assert {(r.lexeme, r.df) for r in index.terms().collect()} == {("two", 1)}
    assert [(r.n, r.avgdl) for r in index.sizes().collect()] == [(1, 1.0)]


QUOTES = {
    'a "b c" d': (["b c"], "a d"),
    "say „eins zwei“ und ‘drei’ x": (["eins zwei", "drei"], "say und x"),
    'open "never closed': ([], 'open "never closed'),
    'open "never “a b” closed': ([], 'open "never “a b” closed'),
    "it's 'two words' isn't": (["two words"], "it's isn't"),
    "'single' 'two it's here' x": (["two it's here"], "'single' x"),
    'empty "" and "  "': ([], "empty and"),
    "“mixed closers\" end": (["mixed closers"], "end"),
    None: ([], ""),
}


def test_quotes(spark):
    rows = spark.createDataFrame([(q,) for q in QUOTES], "q string").select("q", questions.quoted_phrases(F.col("q")).alias("p"), questions.without_quoted(F.col("q")).alias("r")).collect()
    assert {r.q: (list(r.p), r.r) for r in rows} == QUOTES


def test_texts_of_single_changes_stay_in_place_and_batches_may_cut_texts(spark):
    rows = [("c", i, t, False, None) for i, t in enumerate(["a b a c", None, "", "b b b b b", "x"])]
    changes = spark.createDataFrame(rows, "corpus string, id long, text string, deleted boolean, at timestamp")
    newest = text_index._newest(changes)
    assert "Exchange" not in newest._jdf.queryExecution().executedPlan().toString() and newest.count() == 5
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        found = {(r.id, r.lexeme): (r.tf, r.dl, r.positions) for r in text_index.positional(changes.coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    words = {(0, "a"): (2, 3, [0, 2]), (0, "b"): (1, 3, [1]), (0, "c"): (1, 3, [3]), (3, "b"): (5, 1, [0, 1, 2, 3, 4]), (4, "x"): (1, 1, [0])}
    assert found == words | {(i, None): (0, d, []) for i, d in enumerate([3, 0, 0, 1, 1])}


def test_few_rows_leave_a_task_and_queries_go_in_blocks(spark, tmp_path, monkeypatch):
    texts = {i: f"the of {'the ' * (i % 5)}{'alpha beta ' * (i % 3)}w{i} of the" for i in range(300)}
    index = text_index.TextIndex(spark, str(tmp_path / "index"))
    index.apply(0, spark.createDataFrame([("A", i, t, False, None) for i, t in texts.items()], CHANGES).coalesce(1))
    asked = {q: (f'"of the" {"alpha" if q % 2 else "beta"} w{q}', ("A", [["of", "the"]], ["alpha" if q % 2 else "beta", f"w{q}"])) for q in range(20)}
    asked |= {q: (f"the alpha w{q}", ("A", [], ["the", "alpha", f"w{q}"])) for q in range(20, 40)}
    queries = spark.createDataFrame([(q, "A", text) for q, (text, _) in asked.items()], "query_id long, corpus string, text string")
    state = {("A", i): t for i, t in texts.items()}
    want = {q: [(i, pytest.approx(s, abs=2e-6)) for i, s in best(state, of, 3)] for q, (_, of) in asked.items()}
    tasks = text_index._of_block(index, text_index._asked(index, queries), "query_id long, corpus string, id long, score double", 3, 1.2, 0.75)
    assert tasks.count() <= 40 * 3 * tasks.rdd.getNumPartitions()  # before, every document with a query's lexeme was dealt out
    for words in (text_index._WORDS, 50):
        monkeypatch.setattr(text_index, "_WORDS", words)
        out = defaultdict(list)
        for r in text_index.search(index, queries, 3).orderBy("query_id", "rank").collect():
            out[r.query_id].append((r.id, r.score))
        assert dict(out) == want
