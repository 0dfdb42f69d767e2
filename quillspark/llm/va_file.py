"""Exact top-k inner products with a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import stored
from quillspark.llm.vectors import best_rows, classes, is_query, matrix, usable

_BLOCK = 4096  # approximations scanned in one group
_FIRST = 64  # exact vectors of a query read before its kth score is known


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v, dim) with v = floor(scale * x), whole numbers in doubles."""
    out = usable(rows, id_col, vector_col, nonzero=False)
    return out.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double") + F.lit(0.0)))


def grid(vectors: DataFrame, bits: int) -> dict[int, list[np.ndarray]]:
    """Cell edges of each dimension by length of the vectors: about equally full cells, so that a few far
    values don't leave all others in one. Cell c holds edges[c] to edges[c + 1] - 1."""
    n = 1 << bits
    cuts = F.percentile_approx("x", F.lit([i / n for i in range(1, n)]), 1000)
    flat = vectors.select("dim", F.posexplode("v").alias("at", "x")).groupBy("dim", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"), cuts.alias("cuts"))
    out: dict[int, list[np.ndarray]] = {}
    for r in flat.collect():  # a row per dimension
        edges = out.setdefault(r.dim, [np.empty(0)] * r.dim)
        edges[r.at] = np.append(np.unique([r.low, *(c for c in r.cuts if c > r.low)]), np.nextafter(r.high, np.inf) if abs(r.high) >= 2**53 else r.high + 1)
    return out


def exact_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(qcid, cid, q, v) -> (qcid, cid, score): integer products, or an error beyond 64 bits."""
    for b in batches:
        scores = []
        for q, v in zip(b.column("q"), b.column("v"), strict=True):
            q, v = q.values.to_numpy(), v.values.to_numpy()
            if np.abs(q).max() * np.abs(v).max() * len(q) < 2**53:
                scores.append(int(q @ v))
            else:
                scores.append(sum(int(x) * int(y) for x, y in zip(q.tolist(), v.tolist(), strict=True)))
                if abs(scores[-1]) >= 1 << 63:
                    raise OverflowError("an inner product needs more than 64 bits")
        yield pa.RecordBatch.from_arrays([b.column("qcid"), b.column("cid"), pa.array(scores, pa.int64())], names=["qcid", "cid", "score"])


def search(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, bits: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows
    of largest inner product of floor(scale * x); ties go to the smaller id. The result is exact.

    The approximation file holds a cell number of `bits` bits per dimension. It is scanned in
    blocks against the queries, and gives bounds of each product. What can't be among a
    query's best by the bounds goes; of the rest, the _FIRST of highest bound are read, and then
    those whose bound reaches the kth score of these: no other can enter the result. Equal
    vectors are one entry, whatever their number. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id and empty vectors; vectors
    meet vectors of their own length. Rows that repeat id and vector count once; an id with
    several vectors is a row for each. A product of over 64 bits is an error. Empty table: no rows.
    """
    numbers = whole_numbers(rows, id_col, vector_col, scale)
    vectors = stored(classes(numbers, k + 1))
    edges = grid(vectors, bits)
    need = k + 1

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == d))
                x = matrix(some.column("v"), d)
                cells = np.stack([np.searchsorted(edges[d][i][1:-1], x[:, i], side="right") for i in range(d)], axis=1).astype(np.uint8)
                raw = pa.array([row.tobytes() for row in cells], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("cid"), some.column("dim"), raw], names=["cid", "dim", "cells"])

    asked = numbers.where(is_query(every)).join(vectors.select("v", F.col("cid").alias("qcid")), "v").select("vec_id", "qcid", "v", "dim")
    asked = stored(asked)
    blocks = vectors.groupBy("dim").agg(F.ceil(F.count("*") / _BLOCK).cast("long").alias("blocks"))
    file = vectors.select("cid", "v", "dim").mapInArrow(approximate, "cid long, dim int, cells binary")
    file = file.join(blocks, "dim").select("cid", "dim", "cells", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"))
    sent = asked.dropDuplicates(["qcid"]).join(blocks.toDF("dim", "blocks"), "dim").select("qcid", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def scan(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        names, kinds = ("qcid", "cid", "low", "high"), (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        out: list[tuple] = []
        if mine.num_rows and theirs.num_rows:
            dim = mine["dim"][0].as_py()
            cells = np.frombuffer(b"".join(mine["cells"].to_pylist()), dtype=np.uint8).reshape(-1, dim)
            least = np.stack([edges[dim][i][cells[:, i]] for i in range(dim)], axis=1)
            largest = np.stack([edges[dim][i][1:][cells[:, i]] - 1 for i in range(dim)], axis=1)
            size = np.maximum(np.abs(least), np.abs(largest) + 1)
            cids, qcids, q = mine["cid"].to_numpy(), theirs["qcid"].to_numpy(), matrix(theirs["v"], dim)
            for at in range(0, len(q), 128):
                up, down = np.maximum(q[at : at + 128], 0), np.minimum(q[at : at + 128], 0)
                low, high = up @ least.T + down @ largest.T, up @ largest.T + down @ least.T
                slack = np.abs(q[at : at + 128]) @ size.T * (dim * 2.0**-51)  # what doubles may be off
                low, high = low - slack, high + slack
                kth = -np.partition(-low, min(need, len(cids)) - 1, axis=1)[:, min(need, len(cids)) - 1]
                i, j = np.nonzero(high >= kth[:, None])
                out.append((qcids[at + i], cids[j], low[i, j], high[i, j]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, kinds, strict=True)})

    near = stored(file.groupBy("dim", "block").cogroup(sent.groupBy("dim", "block")).applyInArrow(scan, "qcid long, cid long, low double, high double"))
    nth = F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("low")))
    sure = near.withColumn("nth", nth).where(F.col("nth") <= need).groupBy("qcid").agg(F.min("low").alias("sure"), F.count("*").alias("n"))
    left = near.join(sure, "qcid").where((F.col("n") < need) | (F.col("high") >= F.col("sure"))).select("qcid", "cid", "high")
    left = stored(left.withColumn("nth", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("high"), "cid"))))
    asked_once = asked.dropDuplicates(["qcid"]).select("qcid", F.col("v").alias("q"))

    def scores(some: DataFrame) -> DataFrame:
        both = some.select("qcid", "cid").join(vectors.select("cid", "v"), "cid").join(asked_once, "qcid")
        return both.select("qcid", "cid", "q", "v").mapInArrow(exact_products, "qcid long, cid long, score long")

    first = stored(scores(left.where(F.col("nth") <= _FIRST)))
    kth = first.withColumn("nth", F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score")))).where(F.col("nth") == need).select("qcid", F.col("score").alias("kth"))
    later = left.where(F.col("nth") > _FIRST).join(kth, "qcid").where(F.col("high") >= F.col("kth"))
    return best_rows(first.union(scores(later)), vectors, asked, k, "long")
