"""The token cache's hits and misses, and how well and by what documents are scored for toxicity."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspark.llm import token_counts, toxicity
from quillspark.llm.common import scratch_path

JSON = public_tokenizers.path("byte_bpe_50k.json")
SMALL, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def test_cache_encodes_misses_alone(spark, tmp_path):
    library = Tokenizer.from_file(JSON)
    texts = ["one two three", "four", "", None, "one two three", "five six"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cache = scratch_path(spark)
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    stored = lambda: sorted(r.n_tokens for r in spark.read.option("recursiveFileLookup", "true").schema(token_counts.CACHE_SCHEMA).parquet(cache).collect())
    got = lambda rows, path=JSON: {r.id: r.n_tokens for r in token_counts.count_tokens(rows, path, cache).collect()}
    half = table.where("doc_id < 2")
    assert got(half) == {i: want[i] for i in (0, 1)} and len(stored()) == 2
    assert got(table) == want and len(stored()) == 4  # the two known texts aren't encoded again
    assert got(table) == want and len(stored()) == 4
    # a stored count is what is used: change one and it comes back
    part = f"{cache}/tokenizer={token_counts.tokenizer_version(JSON)}"
    rows = spark.read.schema(token_counts.CACHE_SCHEMA).parquet(part).withColumn("n_tokens", F.col("n_tokens") + 100).collect()
    spark.createDataFrame(rows, token_counts.CACHE_SCHEMA).write.mode("append").parquet(part)
    assert got(half) == {i: want[i] + 100 for i in (0, 1)}
    other = tmp_path / "other.json"
    other.write_text(open(JSON).read() + "\n")
    assert got(half, str(other)) == {i: want[i] for i in (0, 1)}  # another file is another version


def scores(spark, place, labels):
    out = toxicity.score_documents(spark.read.parquet(f"{place}/documents.parquet"), labels, threshold=0.3)
    return {r.id: (r.held_out, r.score, r.predicted) for r in out.collect()}


def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    found = scores(spark, LARGE, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and found[r.doc_id][0]}
    hits = sum(found[d][2] and t for d, t in truth.items())
    assert hits / sum(truth.values()) >= 0.85 and hits / max(1, sum(found[d][2] for d in truth)) >= 0.9


def test_held_out_labels_reach_no_score(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    first = scores(spark, SMALL, labels)
    rows = [(r.doc_id, r.quality, 1 - r.toxic if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 else r.toxic) for r in labels.collect()]
    assert scores(spark, SMALL, spark.createDataFrame(rows, labels.schema)) == first
