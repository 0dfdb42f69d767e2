"""Near duplicates by SimHash with a byte-position inverted index and count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.fingerprint_pairs import block_masks, list_components, posting_lists

_CHUNK = 1 << 16  # shingles whose bits are counted at once: bounds memory for very long texts


def simhash(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Majority fingerprint of the word shingles of text, as an unsigned 64-bit integer.

    A-Z are lower-cased; words lie between ASCII white space; shingles count with
    their repeats. Fewer words than `width`: one shingle of them all. No word, null
    and empty text: 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), dtype=">u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        ones += np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): a row per row of docs, fp a signed long with the fingerprint's bits."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, fp long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([simhash(t.as_py(), width) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")).mapInArrow(run, schema)


def shared_bytes(a: Column, b: Column) -> Column:
    """In how many of the eight byte positions two fingerprints agree."""
    x = a.bitwiseXOR(b)
    return sum((F.when(x.bitwiseAND(F.lit(m)) == 0, 1).otherwise(0) for m in block_masks(8, 1)), F.lit(0))


def near_components(fps: DataFrame, max_bits: int = 2, long_list: int = 256) -> DataFrame:
    """(node, component): the distinct fingerprints in column fp that link with another one, at
    max_bits (0 to 3) differing bits or fewer, and the least one reachable.

    Pairs that differ in k bits agree in at least 8 - k byte positions. A posting list of one
    byte position would hold 1/256 of the corpus, so the index is keyed by groups of positions:
    of four two-byte groups at least 4 - k are shared whole, and every choice of that many makes
    a key. Candidates tally their shared positional bytes, stay at 8 - k or more, and are
    verified bit by bit. A list longer than `long_list` is split exactly by all choices of
    8 - k whole positions, so no list is cut.
    """
    return simhash_components(fps.select(F.col("fp").alias("node"), "fp"), max_bits, lambda pairs: pairs, long_list)


def simhash_components(rows: DataFrame, max_bits: int, verify: Callable[[DataFrame], DataFrame], long_list: int = 256) -> DataFrame:
    """near_components of rows (node, fp); verify keeps the true links of pairs (a, b) of nodes."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits: 0 to 3")

    def near(a: Column, b: Column) -> Column:
        return (shared_bytes(a, b) >= 8 - max_bits) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)

    lists = posting_lists(rows, block_masks(4, 4 - max_bits), block_masks(8, 8 - max_bits), long_list)
    return list_components(lists, near, verify)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2, width: int = 3) -> DataFrame:
    """(id, fp, component_id): a row per row of docs; component_id is the smallest id linked, directly or not.

    Null and empty texts have fingerprint 0 and link with one another. A null id stays a
    row; it is never a component's smallest id unless the component has no other, then
    component_id is null. Repeated rows and equal ids keep a row each. Other columns of
    docs are not read. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, width))
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")))
    linked = near_components(classes.select("fp"), max_bits).withColumnRenamed("node", "fp")
    linked = linked.join(classes, "fp")
    least = linked.groupBy("component").agg(F.min("least").alias("linked_least"))
    of_fp = linked.join(least, "component").select("fp", "linked_least")
    of_fp = classes.join(of_fp, "fp", "left").select("fp", F.coalesce("linked_least", "least").alias("component_id"))
    return fps.join(of_fp, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the row with the smallest id.

    Rows that share the smallest id: the one with the smallest SHA-256 of its text, once if
    rows repeat. A group whose ids are all null keeps one row likewise.
    """
    keyed = keyed_by_id(docs, id_col, text_col)
    fps = stored(fingerprints(keyed, "__id", text_col))
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("least")))
    linked = near_components(classes.select("fp"), max_bits).withColumnRenamed("node", "fp")
    return least_of_components(keyed, docs.columns, fps, classes, linked)


def keyed_by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with __id, by which rows are ordered: null ids last, ties by the digest of the text."""
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    return docs.withColumn("__id", F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), digest.alias("digest")))


def least_of_components(keyed: DataFrame, columns: list[str], fps: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """The row of least __id of each component, once; fps (id, fp), classes (fp, least), linked (fp, component)."""
    linked = classes.join(linked, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = linked.groupBy("component").agg(F.min("least").alias("least"))
    kept = fps.join(least, F.col("id") == F.col("least")).groupBy(F.col("id").alias("kid")).agg(F.count("*").alias("copies"))
    near = keyed.join(kept, keyed["__id"].eqNullSafe(kept["kid"]))
    once = near.where("copies = 1").select(*columns)
    again = near.where("copies > 1").dropDuplicates(["__id"]).select(*columns)
    return once.unionByName(again)
