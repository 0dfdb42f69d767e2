"""Resampling towards a target distribution by hashed word n-grams.

External sort-count: one pass packs each text's buckets into uint16 streams with document
offsets and writes them; buckets are counted by sorting the streams and run-length encoding
them; a second pass over the streams gathers the buckets' gains and sums them by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, stored
from quillspark.llm.encoders import slices

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what lies between words, once A-Z are lower-cased
_PACKED = "docs binary, words binary, features binary, stream binary"
_MOST_BUCKETS = 1 << 16  # a bucket is packed into 16 bits
_AT_ONCE = 8 << 20  # bytes of text whose words are held together


def features(texts: pa.Array, width: int = 1, buckets: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, buckets of all features in text order): the
    runs of 1 to `width` words, joined by one space; a text's runs of one word come first.
    A bucket is the crc32 of a feature's UTF-8 bytes modulo `buckets`."""
    cut = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(texts, "")), _BREAKS)
    words, owner = cut.flatten(), pc.list_parent_indices(cut)
    full = pc.not_equal(words, "")
    words, owner = words.filter(full), owner.filter(full).to_numpy().astype(np.int64)
    n_words = np.bincount(owner, minlength=len(texts))
    parts, owners, run = [], [], words
    for n in range(1, width + 1):
        if n > 1:
            run = pc.binary_join_element_wise(run.slice(0, max(0, len(run) - 1)), words.slice(n - 1), " ")
        at = owner[: len(run)]
        whole = at == owner[n - 1 :]  # the run's last word is of the same text
        coded = run.filter(pa.array(whole)).dictionary_encode()
        crc = np.fromiter((zlib.crc32(w.encode()) % buckets for w in coded.dictionary.to_pylist()), dtype=np.uint16, count=len(coded.dictionary))
        parts.append(crc[coded.indices.to_numpy()])
        owners.append(at[whole])
    every = np.concatenate(owners)
    order = np.argsort(every, kind="stable") if width > 1 else slice(None)
    return n_words, np.bincount(every, minlength=len(texts)), np.concatenate(parts)[order]


def pack(texts: DataFrame, width: int, buckets: int) -> DataFrame:
    """(id, text) -> rows of many documents each: their ids (longs; docs), their numbers of words and
    of features (longs; words, features) and all their buckets in a row (uint16; stream)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for some in slices(b.column(1), _AT_ONCE):
                ids = b.column(0).slice(at, len(some)).to_numpy(zero_copy_only=False)
                at += len(some)
                n_words, n_features, stream = features(some, width, buckets)
                row = (ids.astype("<i8"), n_words.astype("<i8"), n_features.astype("<i8"), stream.astype("<u2"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], names=["docs", "words", "features", "stream"])

    return texts.mapInArrow(run, _PACKED)


def count_buckets(packed: DataFrame) -> DataFrame:
    """(bucket, n): how often each bucket is in the streams. Every task sorts its streams, one at
    a time, and sends each bucket's count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_MOST_BUCKETS, dtype=np.int64)
        for b in batches:
            for s in b.column(0):
                ordered = np.sort(np.frombuffer(s.as_buffer(), dtype="<u2"))
                starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[starts]] += np.diff(np.append(starts, len(ordered)))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int64)), pa.array(total[met])], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of target to source) by bucket, in doubles."""
    s_all, t_all = sum(source.values()), sum(target.values())
    ratio = ((target.get(b, 0) + 1.0) * (s_all + buckets) / ((source.get(b, 0) + 1.0) * (t_all + buckets)) for b in range(buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def weigh(packed: DataFrame, of_bucket: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): weight is the floored mean gain of a document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, n, stream in zip(*(b.column(i) for i in range(4)), strict=True):
                n = np.frombuffer(n.as_buffer(), dtype="<i8")
                gathered = of_bucket[np.frombuffer(stream.as_buffer(), dtype="<u2")]
                some = n > 0  # reduceat gives an element, not 0, for an empty slice
                weight = np.zeros(len(n), dtype=np.int64)
                if some.any():
                    weight[some] = np.add.reduceat(gathered, (np.cumsum(n) - n)[some]) // n[some]
                columns = [np.frombuffer(ids.as_buffer(), dtype="<i8"), np.frombuffer(words.as_buffer(), dtype="<i8"), n, weight]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["id", "n_words", "n_features", "weight"])

    return packed.select("docs", "words", "features", "stream").mapInArrow(run, "id long, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int) -> Column:
    """Gumbel noise of an id in thousandths, from the first 32 bits of the SHA-256 of `seed:id`."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", width: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """(id, n_features, weight, score, rank), a row per row of docs: rank is 1, 2, 3... for the drawn
    `percent` of the documents with `least_words` words or more, by score, and null for others.

    weight is the floored mean over a document's features of its buckets' gains, score that and
    Gumbel noise, so that the highest scores are a draw without replacement by exp(weight / 1000).
    Equal scores: the smaller id first, null ids last, then fewer features. Null and empty texts
    have no features and weight 0; a null id's noise is that of an empty id. Repeated rows count
    and are drawn as rows of their own. Other columns are not read. An empty docs gives an empty
    result; an empty target gives gains from smoothing alone.

    To the driver go one count for each bucket (65 536 at most) and, for the cut, nothing: ranks
    come from counts of equal scores, whose noise keeps any of them to a thousandth of the rows.
    """
    if not 1 <= buckets <= _MOST_BUCKETS:
        raise ValueError(f"buckets: 1 to {_MOST_BUCKETS}")
    packed_of = lambda df, id_, text: pack(df.select(id_.cast("long").alias("id"), F.col(text).cast("string").alias("t")), width, buckets)
    with Scratch(docs.sparkSession) as scratch:
        # null ids are packed as their own number, the least long, and come out as null again
        none = -(1 << 63)
        packed = scratch.stored(packed_of(docs, F.coalesce(F.col(id_col).cast("long"), F.lit(none)), text_col))
        source = dict(map(tuple, count_buckets(packed).collect()))
        wanted = dict(map(tuple, count_buckets(packed_of(target, F.lit(0), target_col)).collect()))
        weighed = weigh(packed, gains(source, wanted, buckets)).withColumn("id", F.nullif("id", F.lit(none)))
        scored = stored(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    return _ranked(scored, percent, least_words)


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """rank by descending score among the rows with enough words. Scores are whole thousandths, so a
    table of how many rows have each is small; a window over it, not over the rows, gives what lies before."""
    able = scored.where(F.col("n_words") >= least_words)
    higher = Window.orderBy(F.desc("score"))
    counts = able.groupBy("score").agg(F.count("*").alias("n"))
    counts = counts.select("score", (F.sum("n").over(higher) - F.col("n")).alias("before"), F.floor(F.sum("n").over(Window.partitionBy()) * percent / 100).alias("drawn"))
    counts = counts.where("before < drawn").withColumnRenamed("score", "at")
    same = Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "n_features")
    place = F.col("before") + F.row_number().over(same)
    high = able.join(counts, F.col("score") == F.col("at")).withColumn("place", place)
    high = high.withColumn("rank", F.when(F.col("place") <= F.col("drawn"), F.col("place")).cast("long"))
    low = scored.join(counts, (F.col("score") == F.col("at")) & (F.col("n_words") >= least_words), "left_anti").withColumn("rank", F.lit(None).cast("long"))
    columns = ["id", "n_features", "weight", "score", "rank"]
    return high.select(*columns).unionByName(low.select(*columns))
