"""Packing documents into fixed-length sequences: best fit, then swap-based local search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import stored
from quillspark.llm.encoders import encoder, slices


def cut_pieces(docs: DataFrame, tokenizer_path: str, length: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and end_id, cut if longer than `length`.

    All pieces but the first have `length` tokens; the first takes what is left over.
    """
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer_path)
        for b in batches:
            rows: list[tuple] = []
            of: list[int] = []
            at = 0
            for some in slices(b.column(1)):
                ids, bounds = own.encode(some)
                raw = memoryview(ids.tobytes())
                edges = bounds.tolist()
                for i in range(len(some)):
                    n = edges[i + 1] - edges[i] + 1
                    whole = raw[4 * edges[i] : 4 * edges[i + 1]]
                    to = n % length or length
                    start = piece = 0
                    while start < n:
                        crc = zlib.crc32(whole[4 * start : 4 * min(to, n - 1)])
                        rows.append((piece, start, to - start, zlib.crc32(end, crc) if to == n else crc))
                        of.append(at + i)
                        start, to, piece = to, to + length, piece + 1
                at += len(some)
            piece, start, size, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item; items come largest first. The fullest bin with room takes the item."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r: a bin with r tokens left
    bins = np.empty(len(sizes), dtype=np.int64)
    n = 0
    for i, size in enumerate(sizes.tolist()):
        fits = free >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free ^= 1 << left
        else:
            b, left, n = n, capacity, n + 1
        bins[i] = b
        left -= size
        if not room[left]:
            free |= 1 << left
        room[left].append(b)
    return bins


def local_search(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Empties bins by moves and exchanges between underfull bins.

    The emptiest bin gives: a document moves, is exchanged for a smaller one, or for two
    smaller ones, or two of its documents for a larger one, wherever the other bin has room
    for the difference. Each step increases the sum of squared fills, so the search ends;
    the largest step is taken first. It stops at the least possible number of bins, or when
    the emptiest bin has no step left.
    """
    bins = bins.copy()
    fill = np.bincount(bins, weights=sizes).astype(np.int64)
    least = -(-int(sizes.sum()) // capacity)
    while np.count_nonzero(fill) > least:
        gives = int(np.where(fill > 0, fill, capacity + 1).argmin())
        others = np.flatnonzero((fill[bins] < capacity) & (bins != gives))
        if not len(others):
            break
        gap = (capacity - fill)[bins[others]]
        lead = fill[bins[others]] - fill[gives]
        step = _best_step(sizes, bins, np.flatnonzero(bins == gives), others, gap, lead)
        if step is None:
            break
        out, back, to = step
        moved = int(sizes[out].sum() - sizes[back].sum())
        bins[out], bins[back] = to, gives
        fill[to] += moved
        fill[gives] -= moved
    return bins


def _best_step(sizes, bins, mine, others, gap, lead):
    """(documents out, documents back, bin) of the largest gain in squared fill, or None."""
    best, found = 0, None

    def offer(delta: np.ndarray, some: np.ndarray, out: list[int], back) -> None:
        nonlocal best, found
        gain = np.where((delta > 0) & (delta <= gap[some]), 2 * delta * (lead[some] + delta), 0)
        if len(gain) and (i := int(gain.argmax())) is not None and gain[i] > best:
            best, found = int(gain[i]), (np.array(out), np.array(back(i), dtype=np.int64), int(bins[others[some[i]]]))

    every = np.arange(len(others))
    by_bin = np.lexsort((sizes[others], bins[others]))
    left, right = by_bin[:-1], by_bin[1:]
    same = bins[others[left]] == bins[others[right]]
    pairs = [(left[same], right[same])]  # neighbours in size; and the smallest with each other one
    heads = np.concatenate(([True], ~same))
    first = by_bin[np.maximum.accumulate(np.where(heads, np.arange(len(by_bin)), 0))]
    far = (first != by_bin)
    pairs.append((first[far], by_bin[far]))
    for x in mine.tolist():
        offer(np.full(len(others), sizes[x]), every, [x], lambda i: [])
        offer(sizes[x] - sizes[others], every, [x], lambda i: [others[i]])
        for a, b in pairs:
            offer(sizes[x] - sizes[others[a]] - sizes[others[b]], a, [x], lambda i, a=a, b=b: [others[a[i]], others[b[i]]])
    for i, x in enumerate(mine.tolist()):
        for y in mine[i + 1 :].tolist():
            offer(sizes[x] + sizes[y] - sizes[others], every, [x, y], lambda i: [others[i]])
    return found


def pack(pieces: DataFrame, length: int, group: int = 8192) -> DataFrame:
    """Adds sequence_id and offset to pieces (id, piece, start, length, ...) of at most `length` tokens.

    Rows are dealt by their number in the table into groups of about `group`, so that equal
    ones, however many, spread over all groups. Each group is packed by itself and a task's
    memory doesn't grow with the corpus; each group adds about one sequence to what a single
    packing would need. pieces must be a stored table, which numbers its rows alike when a task
    is run again. sequence_id holds the group's number in its upper bits. Ties between equal
    lengths go by id, piece and start; nulls first. Equal rows each keep a place of their own;
    an empty table gives an empty result.
    """
    n = pieces.count()
    groups = max(1, -(-n // group))
    keyed = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, [("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("start", "ascending")], null_placement="at_start"))
        sizes = rows["length"].to_numpy()
        bins = local_search(sizes, best_fit(sizes, length), length)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        new = np.concatenate(([True], bins[order][1:] != bins[order][:-1]))
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(new, before, 0))
        numbers = (rows["__group"].to_numpy() << 24) + bins
        return rows.drop_columns("__group").append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offset))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return keyed.groupBy("__group").applyInArrow(one, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): a row per piece.

    Null and empty texts are the end id alone. Null, equal and repeated ids are packed as
    documents of their own. Other columns of docs are not read. No document: no row.
    """
    return pack(stored(cut_pieces(docs, tokenizer_path, length, end_id, id_col, text_col)), length)
