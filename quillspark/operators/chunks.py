"""Splitting documents into chunks, and reading chunks with their surroundings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions.text import content_hash

# fixed values: separators from coarse to fine; after the last, text is cut by length
SEPARATORS = ("\n\n", "\n", " ")
MARKDOWN = ("\n# ", "\n## ", "\n### ", "\n#### ", "\n\n", "\n", " ")
CODE = ("\nfunction ", "\nasync function ", "\nclass ", "\ndef ", "\nfn ", "\n\n", "\n", " ")


def windows(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, total, content): consecutive windows of `size` characters; no text, no chunk."""
    n = F.ceil(F.char_length(text_col) / size).cast("int")
    rows = docs.where(F.char_length(text_col) > 0).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), n.alias("total"))
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("total") - 1)))
    return rows.select("doc_id", "chunk_index", "total", F.substring("t", F.col("chunk_index") * size + 1, F.lit(size)).alias("content"))


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of about `size` tokens (four characters each): parts between the coarsest separator are
    joined while they fit; a part that is too long is split by the next one, at last by length.
    Each chunk after the first begins with the last `overlap` tokens of the one before, from a word on."""
    most = 4 * size

    def parts(t: str, ladder: tuple[str, ...]) -> Iterator[str]:
        if len(t) <= most:
            yield t
        elif not ladder:
            yield from (t[i : i + most] for i in range(0, len(t), most))
        else:
            pieces = t.split(ladder[0])
            for i, p in enumerate(pieces):
                yield from parts(p + ladder[0] * (i + 1 < len(pieces)), ladder[1:])

    out: list[str] = []
    held = ""
    for p in parts(text, separators):
        if held and len(held) + len(p) > most:
            out.append(held)
            tail = held[-min(4 * overlap, most - len(p)) :] if overlap and len(p) < most else ""  # a chunk with its overlap keeps the limit
            held = tail[tail.find(" ") + 1 :] if " " in tail else ""
        held += p
    if held.strip():
        out.append(held)
    return [c.strip() for c in out if c.strip()]


def split(docs: DataFrame, size: int = 512, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_index, total, content) by split_text, a batch of documents at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, len(found), c) for d, t in zip(b["doc_id"], b["t"], strict=True) for found in [split_text(t or "", size, overlap)] for i, c in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "total", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, chunk_index int, total int, content string")


def parents_and_children(docs: DataFrame, size: int = 1024, child: int = 256, overlap: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, parent_index, chunk_index, content): each document's chunks, each split again; chunk_index
    counts through the document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["t"], strict=True):
                found = [(p, c) for p, parent in enumerate(split_text(t or "", size, 0)) for c in split_text(parent, child, overlap)]
                rows += [(d, p, i, c) for i, (p, c) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "parent_index", "chunk_index", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(run, f"doc_id {kind}, parent_index int, chunk_index int, content string")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, at, depth, title, crumbs): the markdown headings of each text, with those that enclose them.
    A heading ends all of its own depth and deeper."""
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("at", "line")).where(F.col("line").rlike(r"^#{1,6}\s+\S"))
    heads = lines.select("doc_id", "at", F.char_length(F.regexp_extract("line", "^(#+)", 1)).alias("depth"), F.trim(F.regexp_replace("line", r"^#+\s+|\s+#+\s*$", "")).alias("title"))
    before = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a heading of depth d encloses this one if none of depth d or less came after it
    for d in range(1, 7):
        level = F.last(F.when(F.col("depth") == d, F.struct("at", "title")), ignorenulls=True).over(before)
        heads = heads.withColumn(f"_{d}", level)
    for d in range(1, 7):
        ended = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_{e}")["at"], F.lit(-1)) for e in range(1, d)])
        heads = heads.withColumn(f"c{d}", F.when((F.col("depth") >= d) & (F.col(f"_{d}")["at"] > ended), F.col(f"_{d}")["title"]))
    crumbs = F.concat_ws(" > ", *[f"c{d}" for d in range(1, 7)])
    return heads.select("doc_id", "at", "depth", "title", crumbs.alias("crumbs"))


def outline(chunks: DataFrame, crumb: str = "crumbs") -> DataFrame:
    """(doc_id, crumbs): each document's distinct breadcrumbs in the order they first occur."""
    first = chunks.groupBy("doc_id", crumb).agg(F.min("chunk_index").alias("at"))
    listed = F.array_sort(F.collect_list(F.struct("at", crumb)))
    return first.groupBy("doc_id").agg(F.transform(listed, lambda x: x[crumb]).alias("crumbs"))


def with_neighbours(hits: DataFrame, chunks: DataFrame, reach: int) -> DataFrame:
    """hits (query_id, doc_id, chunk_index, ...): content becomes that of the chunks up to `reach`
    away in the same document, in order, joined by a blank line."""
    around = hits.select("query_id", "doc_id", F.col("chunk_index").alias("hit"), F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index"))
    parts = around.join(chunks.select("doc_id", "chunk_index", "content"), ["doc_id", "chunk_index"])
    joined = parts.groupBy("query_id", "doc_id", "hit").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("p"))
    return joined.select("query_id", "doc_id", F.col("hit").alias("chunk_index"), F.array_join("p.content", "\n\n").alias("content"))


def one_per_parent(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """hits (query_id, parent_id, rank): the best hit of each parent, with the parent's content."""
    first = F.row_number().over(Window.partitionBy("query_id", "parent_id").orderBy("rank"))
    best = hits.withColumn("nth", first).where("nth = 1").drop("nth")
    return best.join(parents.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("content")), "parent_id", "left")


def first_of_content(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs whose normalised content is the first of its hash and not known; blank ones all stay."""
    hashes = docs.select(F.col(id_col).alias("__id"), content_hash(F.col(text_col)).alias("content_hash"))
    # a blank text is a group of its own by its id; an aggregate sums groups of any size up before the shuffle
    group = F.when(F.col("content_hash") == "", F.col("__id"))
    least = hashes.groupBy("content_hash", group.alias("__blank")).agg(F.min("__id").alias("__id")).drop("__blank")
    if known is not None:
        least = least.join(known.select("content_hash").where("content_hash <> ''"), "content_hash", "left_anti")
    return docs.join(least, docs[id_col] == F.col("__id")).drop("__id")
