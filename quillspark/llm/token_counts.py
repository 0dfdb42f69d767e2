"""Token counts through a cache of content digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.encoders import encoder, slices

CACHE_SCHEMA = "digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file: another file never meets this one's counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def normalised(column: str) -> F.Column:
    """Content whose digest is the cache key. Any change of a text may change its tokens, so
    only null and empty text become one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def encode_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(digest, text) -> (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for b in batches:
            counts = [np.diff(own.encode(some)[1]) for some in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64))], names=["digest", "n_tokens"])

    return texts.mapInArrow(run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): a row per row of docs, repeated rows included.

    Texts are looked up in cache_path by digest and tokenizer version; each distinct text
    without a stored count is encoded once and its count appended there. Null text counts
    as empty: 0 bytes and 0 tokens. Null and repeated ids keep their rows; other columns
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    part = f"{cache_path.rstrip('/')}/tokenizer={tokenizer_version(tokenizer_path)}"
    texts = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    texts = texts.withColumn("digest", F.unhex(F.sha2("t", 256)))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(part)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    misses = texts.select("digest", "t")
    if known is not None:
        misses = misses.join(known.select("digest"), "digest", "left_anti")
    encode_counts(misses.dropDuplicates(["digest"]), tokenizer_path).write.mode("append").parquet(part)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(part).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    sized = texts.select("id", "digest", F.octet_length("t").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
