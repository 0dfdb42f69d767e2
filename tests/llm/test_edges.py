"""Null, empty, repeated and clashing input of every numbered operator."""

from __future__ import annotations

import public_tokenizers
import pytest

from quillspark.llm import ann, bpe, html_extraction, line_dedup, packing, pii, simhash, token_counts, toxicity, va_file
from quillspark.llm.common import scratch_path

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "alpha beta gamma delta epsilon " * 4000
TEXTS = [(1, "one line here\ntwo"), (1, "one line here\ntwo"), (2, None), (3, ""), (None, "no id\n\n"), (4, LONG), (5, "mail a.b@c.example.org or +44 20 7946 0958")]
FIELDS = "doc_id long, text string, id string, t int, fp string, n_lines int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", 2) for r in TEXTS], FIELDS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")


RUNS = {
    "simhash": lambda d, x: simhash.near_duplicates(d),
    "pii": lambda d, x: pii.find(d, pii.fit(d)),
    "bpe": lambda d, x: bpe.encode_decode_digests(d, RANKS, public_tokenizers.PATTERN),
    "toxicity": lambda d, x: toxicity.score_documents(d, x),
    "tokens": lambda d, x: token_counts.count_tokens(d, JSON, scratch_path(d.sparkSession)),
    "lines": lambda d, x: line_dedup.dedup_lines(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_every_row(docs, labels, name):
    assert RUNS[name](docs, labels).count() == len(TEXTS)
    assert RUNS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_near_duplicates_keep_one(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id is not None)
    assert [k[0] for k in kept] == [1, 2, 4, 5]  # equal rows once; of the null and empty texts one


def test_lines(docs, spark):
    assert [r.text for r in line_dedup.dedup_lines(docs).where("doc_id = 1").collect()] == ["one line here\ntwo"] * 2
    words = [f"word{i}" for i in range(60)]
    near = [" ".join(words), " ".join(words), "unlike " + " ".join(f"other{i}" for i in range(30))]
    rows = spark.createDataFrame([(1, near[0] + "\nown first"), (2, "own second\n" + near[1].upper()), (3, near[2])], "doc_id long, text string")
    out = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(rows).collect()}
    assert out == {1: (near[0] + "\nown first", 0), 2: ("own second", 1), 3: (near[2], 0)}


def test_packing(docs):
    out = packing.pack_documents(docs, JSON).toPandas()
    assert len(out[out.id == 2]) == 1 and out[out.id == 2].length.tolist() == [1] and len(out[out.id == 1]) == 2
    assert packing.pack_documents(docs.limit(0), JSON).count() == 0


def test_redacted(docs):
    texts = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert "@" not in texts[5] and "7946" not in texts[5] and texts[2] is None and texts[4] == LONG


def test_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.example/x", None, 1), (2, None, "", 1), (3, "http://a.example/y", "<body><nav>menu</nav><article><p>One &amp; two</p><p>three</p></article></body>", 1)], "page_id long, url string, html string, text int")
    assert {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(pages).collect()} == {1: ("", 0), 2: ("", 0), 3: ("One & two\nthree", 15)}
    assert html_extraction.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("search", [ann.search, va_file.search])
def test_vectors(spark, search):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (50, [float("nan"), 1.0]), (None, [1.0, 1.0]), (100, [2.0, 1.0]), (7, [-1.0, 0.5])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    out = [(r.query_id, r.rank, r.vec_id) for r in search(table, every=50, k=2).orderBy("query_id", "rank").collect()]
    assert out[:2] == ([(0, 1, 1), (0, 2, 2)] if search is ann.search else [(0, 1, 1), (0, 2, 2)]) and {q for q, _, _ in out} == {0, 100}
    assert search(table.limit(0)).count() == 0
