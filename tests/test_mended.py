"""Deep trees, dependency levels, grades, links of pages, and notes that a stream remembers."""

from __future__ import annotations

import datetime
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from quillspark.functions.text import resolved
from quillspark.operators import filters, graph
from quillspark.sources.tables import page_links
from quillspark.streaming import memory


def test_sixty_levels_and_a_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(60, 5), (None, 3)], "parent long, node long")
    out = {r.node: r.depth for r in graph.descendants(chain, spark.createDataFrame([(0,), (None,)], "root long")).collect()}
    assert out == {i: i for i in range(61)}


def test_dependency_levels(spark):
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node long")
    needs = [(2, 1), (3, 1), (4, 2), (4, 3), (5, 4), (5, 1), (7, 6), (7, 6)]
    table = lambda rows: spark.createDataFrame(rows, "node long, parent long")
    assert {r.node: r.level for r in graph.dependency_levels(nodes, table(needs)).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3, 6: 0, 7: 1}
    assert graph.dependency_levels(nodes.limit(0), table([])).count() == 0
    for bad, message in (([*needs, (1, 5)], "cycle"), ([(1, 1)], "cycle"), ([(2, 99)], "no node")):
        with pytest.raises(ValueError, match=message):
            graph.dependency_levels(nodes, table(bad))
    with pytest.raises(ValueError, match="twice"):
        graph.dependency_levels(nodes.union(nodes), table(needs))


def test_grades(spark):
    cases = {1: ["relevant:a"] * 3, 2: ["relevant:a"], 3: ["relevant:a", "relevant:b"], 4: ["ambiguous:a"], 5: ["irrelevant:a"], 6: ["relevant:", "ambiguous:b"], 7: ["relevant:a", "relevant:b", "relevant:c"]}
    rows = spark.createDataFrame([(q, *g.split(":")) for q, gs in cases.items() for g in gs], "query_id long, grade string, file_id string")
    act = lambda **k: {r.query_id: r.action for r in filters.grade_action(rows, **k).collect()}
    assert act() == {1: "proceed", 2: "proceed", 3: "rewrite", 4: "proceed", 5: "abstain", 6: "rewrite", 7: "proceed"}
    assert act(rewritten=True) == {1: "proceed", 2: "proceed", 3: "proceed", 4: "proceed", 5: "abstain", 6: "proceed", 7: "proceed"}
    assert act(least=2)[3] == "proceed"


BASES = ["https://a.example/d/e/p.html?x=1#f", "http://b.example", "https://c.example/d/"]
TARGETS = ["y.html", "../z", "/u", "//h.example/q", "?k=2", "./a/./b/../c", "https://o.example/p#top", "HTTP://o.example/x", "../../../up", "a/..", "q?r=../s", "mailto:x@y.z", "javascript:void(0)", "ftp://x/y"]


def test_links_as_seen_from_the_page(spark):
    rows = spark.createDataFrame([(b, t) for b in BASES for t in TARGETS], "b string, t string")
    got = {(r.b, r.t): r.u for r in rows.select("b", "t", resolved(F.col("b"), F.col("t")).alias("u")).collect()}
    for (b, t), u in got.items():
        whole = urldefrag(urljoin(b, t)).url
        if not whole.lower().startswith("http"):
            assert u is None
        elif t == "HTTP://o.example/x":
            assert u.lower() == whole.lower()
        else:
            assert u == whole, (b, t)


def test_page_links(spark):
    html = """<a href="y.html">1</a> <A class="x>y" HREF='../z#s'>2</A><a href=/u>3</a><a title='a' href="//b.example/q">4</a>
    <a href="#frag">5</a><a href=" ">6</a><a href="y.html#again">7</a><a name=x>8</a><abbr href="no"></abbr><a href="?a=1&amp;b=2">9</a>"""
    out = page_links(spark.createDataFrame([(1, "https://a.example/d/p.html", html), (2, None, html), (3, "https://a.example/", None)], "page_id long, url string, html string"))
    assert [(r.page_id, r.nth, r.target) for r in out.orderBy("page_id", "nth").collect()] == [(1, i + 1, f"https://{t}") for i, t in enumerate(["a.example/d/y.html", "a.example/z", "a.example/u", "b.example/q", "a.example/d/p.html?a=1&b=2"])]


def test_notes_of_a_stream(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    schema = "chat long, text string, at timestamp, seq long"
    batches = [
        [(1, "a", at(0), 1), (1, "b", at(1), 2), (2, "x", at(1), 3), (3, "y" * 4001, at(1), 4), (None, "z", at(1), 5), (1, None, at(1), 6)],
        [(1, "c", at(2), 7), (1, "d", at(2), 8), (2, "late", at(-5), 9)],  # late, but the watermark has only reached 0:00
        [(4, "far", at(30), 10)],
        [(2, "too late", at(2), 11), (2, "new", at(31), 12)],
    ]
    seen = []
    query = None
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = memory.remembered(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), newest=3, ttl_hours=24)
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend((n, r.chat, r.notes, r.expired) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()  # noqa: B023
        query.awaitTermination()
    by = lambda n: sorted(x[1:] for x in seen if x[0] == n)
    assert by(0) == [(1, "a|b", False), (2, "x", False)]
    assert by(1) == [(1, "b|c|d", False)]  # three are kept; the late note of chat 2 is dropped
    assert (4, "far", False) in by(2) and (1, "", True) in by(2) + by(3) and (2, "", True) in by(2) + by(3)
    assert (2, "new", False) in by(3) and not any("too late" in x[2] for x in seen)
