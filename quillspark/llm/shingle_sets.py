"""Documents whose sets of word shingles overlap: every pair at a Jaccard similarity or more."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, connected_components, stored
from quillspark.llm.fingerprint_pairs import list_components, shared_postings
from quillspark.llm.simhash import keyed_by_id, least_of_components, simhash_components

_SAMPLE = 16  # one document of so many, by hash of its text, is asked for common shingles
_COMMON = 4  # occurrences in the sample from which a shingle is placed by its count
_MOST_WORDS = 1 << 18  # words whose hashes a worker keeps
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SKETCH = 4  # longs of a wide SimHash
_ALIKE = 0.286  # share of its bits beyond which sets are apart: at 0.8 about 0.152 of 256 differ, and this is six deviations more
_BITS = 3  # differing bits up to which the fingerprint index finds pairs
_FEW = 64  # shingles of a set below which its sketch decides nothing
_MOST_COMMON = 50_000  # shingles that are placed so; all others come before them


class _Words(dict[bytes, int]):
    """The hash of each word met, as a table of bounded size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word, 42)
        return out


_HASH = _Words()


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct shingles of text as sorted signed 64-bit hashes; no word: none. Words are
    as in the SimHash operator, and fewer words than `width` are one shingle of them all."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    w = np.fromiter(map(_HASH.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(w))
    n = len(w) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = out * _ODD + w[i : i + n]
    out ^= out >> np.uint64(29)
    return np.unique((out * _ODD).view(np.int64))


def sketch(shingles: np.ndarray) -> list[int]:
    """Majority fingerprint of a set, _SKETCH signed longs."""
    if not len(shingles):
        return [0] * _SKETCH
    ones = np.zeros((_SKETCH, 64), dtype=np.int64)
    for at in range(0, len(shingles), 1 << 15):
        some = shingles[at : at + (1 << 15)].view(np.uint64)
        for i in range(_SKETCH):
            h = (some ^ (some >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * i)
            h ^= h >> np.uint64(27 + i)
            ones[i] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(shingles), axis=1).view(">i8").ravel().tolist()


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit key of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes(), 7) - (1 << 63)


def prefix_length(n: int, least: float) -> int:
    """So many first elements of a set of n, in any one order, hold an element of every set at
    similarity `least` or more: less than n * least elements can't be shared with it."""
    return n - math.ceil(n * least - 1e-9) + 1 if n else 0


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of 256 rows at most: bounds memory for very long texts."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield b.slice(at, 256)


def common_shingles(docs: DataFrame, text_col: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, place of each): shingles that many documents hold, by their count in a
    sample. The order only decides which postings are made, never which pairs are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = [shingle_set(t.as_py(), width) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets))], names=["k"])

    text = F.col(text_col).cast("string")
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(_SAMPLE)) == 0).select(text.alias("t")).mapInArrow(run, "k long")
    counted = some.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") >= _COMMON)
    found = counted.orderBy(F.desc("n"), "k").limit(_MOST_COMMON).toPandas()
    hashes, place = found["k"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(hashes)
    return hashes[order], place[order]


def described(docs: DataFrame, id_col: str, text_col: str, least: float, width: int) -> DataFrame:
    """(id, fp, size, sketch, first): each text's key of its set, the set's size and wide SimHash, and the
    first elements of the set (prefix_length) in one order of all shingles, rare ones first."""
    hashes, place = common_shingles(docs, text_col, width)
    shared = docs.sparkSession.sparkContext.broadcast((hashes, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        for b in pieces(batches):
            keys, sizes, prints, firsts = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py(), width)
                keys.append(set_key(s))
                sizes.append(len(s))
                prints.append(sketch(s))
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.lexsort((s, np.where(known[at] == s, places[at], 0)))]
                firsts.append(s[: prefix_length(len(s), least)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, longs), pa.array(firsts, longs)], names=["id", "fp", "size", "sketch", "first"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"id {kind}, fp long, size int, sketch array<long>, first array<long>")


def similar_components(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, classes: DataFrame, least: float, width: int) -> DataFrame:
    """(node, component): the sets that link with another; sets as described() gives them, classes
    (fp, least) with the id of one document of each.

    SimHash comes first: fingerprints of the sets in the inverted index on groups of byte positions, whose
    candidates stay if they share enough bytes and differ in few bits, and are then verified on
    the texts' sets. Edits move more bits than that index finds, so an exact check follows:
    an inverted index takes the first elements of each set; rows of a posting list stay if sizes
    and positions leave room for enough shared shingles, pairs if their wide SimHashes are
    near, and then the texts' sets are compared in full.
    """
    with Scratch(docs.sparkSession) as scratch:
        # copies have one node: a key that only they share is no list
        rows = sets.select(F.col("fp").alias("node"), "size", F.posexplode("first").alias("pos", "k"))
        shared = scratch.stored(rows.groupBy("k").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("k"))
        lists = rows.join(shared, "k", "left_semi").select("node", F.struct("size", "pos").alias("fp"), "k").distinct()
        lists = scratch.stored(shared_postings(lists, "k"))
        scratch.drop(shared)
        prints = sets.select("fp", "size", *[F.col("sketch")[i].alias(f"s{i}") for i in range(_SKETCH)])
        prints = prints.groupBy("fp").agg(*[F.max(c).alias(c) for c in prints.columns[1:]])

        def room(a: Column, b: Column) -> Column:
            most = F.least(a["pos"], b["pos"]) + 1 + F.least(a["size"] - a["pos"], b["size"] - b["pos"]) - 1
            return most >= (a["size"] + b["size"]) * (least / (1 + least)) - 1e-6

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches):
                keep = []
                for x, y in zip(b.column("ta"), b.column("tb"), strict=True):
                    m, n = shingle_set(x.as_py(), width), shingle_set(y.as_py(), width)
                    common = len(np.intersect1d(m, n, assume_unique=True))
                    keep.append(common >= (len(m) + len(n) - common) * least - 1e-6)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        def verify(pairs: DataFrame) -> DataFrame:
            of = lambda end: prints.toDF(end, *[f"{end}_{c}" for c in prints.columns[1:]])
            apart = sum((F.bit_count(F.col(f"a_s{i}").bitwiseXOR(F.col(f"b_s{i}"))) for i in range(_SKETCH)), F.lit(0))
            few = F.least("a_size", "b_size") < _FEW
            near = pairs.join(of("a"), "a").join(of("b"), "b").where(few | (apart <= int(_ALIKE * 64 * _SKETCH))).select("a", "b")
            near = scratch.stored(near)
            wanted = near.select(F.col("a").alias("fp")).union(near.select("b")).distinct().join(classes, "fp")
            texts = docs.select(F.col(id_col).alias("least"), F.col(text_col).cast("string").alias("t")).join(wanted, "least").select("fp", "t").dropDuplicates(["fp"])
            texts = scratch.stored(texts)
            both = near.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
            out = scratch.stored(both.select("a", "b", "ta", "tb").mapInArrow(compare, "a long, b long"))
            scratch.drop(texts)
            return out

        near = simhash_components(prints.select(F.col("fp").alias("node"), F.col("s0").alias("fp")), _BITS, verify)
        more = list_components(lists, room, verify)
        stars = [found.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")) for found in (near, more)]
        return connected_components(scratch.stored(stars[0].union(stars[1])))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, width: int = 5) -> DataFrame:
    """docs without all but one row of each group of near duplicates: the row with the smallest id.

    Two texts are near duplicates if their sets of `width`-word shingles have Jaccard similarity
    `least` (0.8, to 1) or more; groups are what links join, directly or not. Words and ties are as
    in the SimHash operator; texts without a word, null ones too, are one group. Repeated rows are
    one row; an empty table stays empty; other columns stay as they are.
    """
    if not 0.8 <= least <= 1:
        raise ValueError("least: 0.8 to 1")  # the sketch's limit holds from there
    keyed = keyed_by_id(docs, id_col, text_col)
    with Scratch(docs.sparkSession) as scratch:
        sets = scratch.stored(described(keyed, "__id", text_col, least, width))
        fps = stored(sets.select("id", "fp"))
        first = stored(fps.groupBy("fp").agg(F.min("id").alias("least")))
        linked = similar_components(keyed, "__id", text_col, sets, first, least, width).withColumnRenamed("node", "fp")
    return least_of_components(keyed, docs.columns, fps, first, linked)
