"""Clusters of vectors: k-means, and communities of the exact nearest-neighbour graph."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.communities import local_moves

_BLOCK = 4096  # vectors of a block that meets every other one
_TILE = 512  # vectors of a block whose distances are held at once


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): rows with an id and finite components, as doubles."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(~bad)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T)


# k-means --------------------------------------------------------------------------------------------


def chance(id_: Column, *draw: int) -> Column:
    """An even number between 0 and 1 of an id and a draw."""
    h = F.xxhash64(id_, *(F.lit(d).cast("long") for d in draw))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _picked(rows: DataFrame, race: Column) -> np.ndarray:
    """The vector of the row that is first in a race, ties to the smaller id."""
    first = rows.select(race.alias("race"), "id", "v").where("race IS NOT NULL").agg(F.min_by("v", F.struct("race", "id")).alias("v")).first()
    return np.array(first["v"])


def _with_nearest(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """(id, v, cluster, d, moved): the nearest centroid, the first among equals, and its squared distance;
    moved unless the same one was nearest before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(1))
            d = squared_distances(x, centroids)
            own = d.argmin(axis=1)
            moved = np.ones(len(own), bool) if before is None else own != squared_distances(x, before).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own.astype(np.int32)), pa.array(d[np.arange(len(own)), own]), pa.array(moved)], names=["id", "v", "cluster", "d", "moved"])

    return rows.select("id", "v").mapInArrow(run, "id long, v array<double>, cluster int, d double, moved boolean")


def seeds(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """k first centroids among rows (id, v), each with a chance in proportion to its squared distance to
    those before: the first in a race of exponential times, whose rate is that distance.
    Where all distances are 0, any row may be next."""
    chosen = [_picked(rows, chance(F.col("id"), seed, 0))]
    for i in range(1, k):
        far = _with_nearest(rows, np.array(chosen))
        time = F.when(F.col("d") > 0, -F.log(chance(F.col("id"), seed, i)) / F.col("d"))
        some = far.select("id", "v", time.alias("t")).where("t IS NOT NULL")
        first = some.agg(F.min_by("v", F.struct("t", "id")).alias("v")).first()["v"]
        chosen.append(np.array(first) if first is not None else _picked(rows, chance(F.col("id"), seed, i)))
    return np.array(chosen)


def _step(rows: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(sums, counts, inertia, moved rows). Every task adds up its own rows, so that a row for each
    cluster leaves it, whatever the clusters' sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, spread, moved = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column(0))
            d = squared_distances(x, centroids)
            own = d.argmin(axis=1)
            np.add.at(sums, own, x)
            counts += np.bincount(own, minlength=len(centroids))
            spread += np.bincount(own, weights=d[np.arange(len(own)), own], minlength=len(centroids))
            new = np.ones(len(own), bool) if before is None else own != squared_distances(x, before).argmin(axis=1)
            moved += np.bincount(own, weights=new, minlength=len(centroids)).astype(np.int64)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(sums[some]), pa.list_(pa.float64())), pa.array(counts[some]), pa.array(spread[some]), pa.array(moved[some])], names=["cluster", "sums", "n", "spread", "moved"])

    parts = rows.select("v").mapInArrow(run, "cluster int, sums array<double>, n long, spread double, moved long")
    # the counts travel as one more component of the sums
    every = F.concat("sums", F.array(F.col("n").cast("double"), F.col("spread"), F.col("moved").cast("double")))
    found = parts.select("cluster", F.posexplode(every).alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros((len(centroids), centroids.shape[1] + 3))
    for r in found:
        total[r["cluster"], r["i"]] = r["x"]
    return total[:, :-3], total[:, -3], float(total[:, -2].sum()), int(total[:, -1].sum())


def k_means(vectors: DataFrame, k: int, seed: int = 0, rounds: int = 30, id_col: str = "vec_id", vector_col: str = "embedding", start: np.ndarray | None = None, told: list[float] | None = None) -> tuple[DataFrame, np.ndarray]:
    """((id, cluster), centroids): Lloyd's rounds until no row changes its cluster, `rounds` at most.

    Distances are squared Euclidean; ties go to the smaller cluster. A cluster that loses all its
    rows starts anew at a row drawn by seed. k or fewer rows: each is a cluster, by id. The
    seed and the ids decide every draw. Rows without an id, null, empty and non-finite
    vectors have no part; all others must have one length. told: gets each round's inertia.
    Only k centroids go through the driver. No usable row: an error, as for k under 1.
    """
    if k < 1:
        raise ValueError("k: at least 1")
    rows = usable(vectors, id_col, vector_col)
    n, least, most = rows.agg(F.count("*"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if not n:
        raise ValueError("no vectors")
    if least != most:
        raise ValueError(f"vectors of lengths {least} to {most}")
    if k >= n:
        own = rows.select("id", "v", (F.row_number().over(Window.orderBy("id")) - 1).alias("cluster"))  # k rows at most
        return own.select("id", "cluster"), np.array([r["v"] for r in own.orderBy("cluster").collect()])
    centroids, before = seeds(rows, k, seed) if start is None else start, None
    for i in range(rounds):
        sums, counts, inertia, moved = _step(rows, centroids, before)
        if told is not None:
            told.append(inertia)
        before, centroids = centroids, centroids.copy()
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
        for c in np.flatnonzero(~full):
            centroids[c] = _picked(rows, chance(F.col("id"), seed, k + i, int(c)))
        if not moved and full.all():
            break
    return _with_nearest(rows, before if rounds else centroids).select("id", "cluster"), centroids


def centroids_of(members: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(cluster, size, centroid): the mean vector of members (id, cluster); components are added apart,
    so that a cluster of any size is summed by many tasks."""
    rows = usable(vectors, id_col, vector_col).join(members, "id")
    means = rows.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"), F.count("*").alias("size"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy("cluster").agg(F.max("size").alias("size"), ordered.alias("centroid"))


# nearest-neighbour graph ------------------------------------------------------------------------------


def nearest_neighbours(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = _BLOCK) -> DataFrame:
    """(id, other, d): each row's k nearest of all others, by squared distance to nine decimals, ties to smaller ids.

    Exact: every pair of blocks meets in a group of bounded size, and k rows a vector leave it.
    """
    rows = usable(vectors, id_col, vector_col)
    blocks = max(1, math.ceil(rows.count() / block))
    own = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "v", "own", F.size("v").alias("dim"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def near(met: pa.Table) -> pa.Table:
        ids, own, x = met["id"].to_numpy(), met["own"].to_numpy(), _matrix(met["v"])
        first, last = met["x"][0].as_py(), met["y"][0].as_py()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for mine, theirs in {(first, last), (last, first)}:
            a, b = np.flatnonzero(own == mine), np.flatnonzero(own == theirs)
            b = b[np.argsort(ids[b], kind="stable")]
            for at in range(0, len(a) if len(b) else 0, _TILE):
                some = a[at : at + _TILE]
                d = np.round(squared_distances(x[some], x[b]), 9)
                d[ids[some][:, None] == ids[b][None]] = np.inf
                row, best, kept = _smallest(d, k)
                out.append((ids[some][row], ids[b][best], kept))
        columns = [np.concatenate(c) if out else np.zeros(0) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("id", "other", "d"), columns, strict=True)))

    found = rows.groupBy("dim", "x", "y").applyInArrow(near, "id long, other long, d double")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("d", "other"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _smallest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of each row's k smallest finite values in order, the first columns among equals.
    Only what is no larger than a row's kth is put in order."""
    most = np.partition(d, k - 1, axis=1)[:, k - 1] if k <= d.shape[1] else np.full(len(d), np.inf)
    row, column = np.nonzero((d <= most[:, None]) & np.isfinite(d))
    value = d[row, column]
    order = np.lexsort((column, value, row))
    row, column, value = row[order], column[order], value[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    return row[nth < k], column[nth < k], value[nth < k]


def neighbour_links(near: DataFrame) -> DataFrame:
    """(graph, u, v, w) both ways of nearest neighbours (id, other, d): w is 1 - d / 2, the cosine of
    vectors of length 1, at least a millionth; an edge found from both ends counts once."""
    w = F.greatest(1 - F.col("d") / 2, F.lit(1e-6))
    one = near.select(F.lit(0).alias("graph"), F.col("id").alias("u"), F.col("other").alias("v"), w.alias("w"))
    return one.union(one.select("graph", F.col("v").alias("u"), F.col("u").alias("v"), "w")).groupBy("graph", "u", "v").agg(F.max("w").alias("w"))


def neighbour_clusters(vectors: DataFrame, k: int = 10, resolution: float = 1.0, rounds: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, size): communities of the k-nearest-neighbour graph of vectors, which are taken at length 1.

    cluster is the smallest id in it. k outside of 2 to 200 counts as 10, a resolution outside of
    0 to 10 as 1. Zero vectors have no part; a single row is a cluster.
    """
    k, resolution = k if 2 <= k <= 200 else 10, resolution if 0 < resolution <= 10 else 1.0
    rows = usable(vectors, id_col, vector_col)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("size", size).where("size > 0").select("id", F.transform("v", lambda x: F.try_divide(x, F.col("size"))).alias("v"))
    found = local_moves(neighbour_links(nearest_neighbours(unit, k, "id", "v")), resolution, only_gains=False, pairs=rounds)
    alone = unit.join(found.select(F.col("node").alias("id")), "id", "left_anti").select("id", F.col("id").alias("cluster")).distinct()
    every = found.select(F.col("node").alias("id"), F.col("community").alias("cluster")).unionByName(alone)
    return every.join(every.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("id", "cluster", "size")
