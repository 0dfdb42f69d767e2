"""Exact vector retrieval with array functions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.keyword import top_k

_HUGE = 1e150  # components from which products overflow
_BLOCK = 8192  # vectors of a block that meets every other one
_TILE = 256  # vectors of a block whose products are held at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths and zero vectors."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def truncated(v: Column, dims: int) -> Column:
    """The first dims components at length 1; null where there are fewer or all are 0."""
    def unit(head: Column) -> Column:
        norm = F.struct(head.alias("v"), F.sqrt(dot(head, head)).alias("norm"))
        return F.transform(F.array(norm), lambda s: F.when(s["norm"] > 0, F.transform(s["v"], lambda x: x.cast("double") / s["norm"])))[0]  # the norm is made once

    return F.when(F.size(v) >= dims, F.transform(F.array(F.slice(v, 1, dims)), unit)[0])


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = _BLOCK) -> DataFrame:
    """(query_id, id, score, rank): nearest of all vectors but the query's own, ties of rounded scores to smaller ids.

    Exact: each block of the queries meets each block of the rows in a group of bounded size, and k
    rows a query leave it. Vectors that are null or hold null, non-finite or huge components
    are compared row by row, with what such a cosine is in SQL.
    """
    q, rows = _marked(queries, id_col, vector_col), _marked(vectors, id_col, vector_col)
    (n_q, n_q_odd), (n_rows, n_odd) = (side.agg(F.count_if("plain"), F.count_if(~F.col("plain"))).first() for side in (q, rows))
    x, y = max(1, math.ceil(n_q / block)), max(1, math.ceil(n_rows / block))
    own = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = q.where("plain").select("id", "v", F.lit(True).alias("asks"), own(x).alias("x"), every(y).alias("y"))
    asked = rows.where("plain").select("id", "v", F.lit(False).alias("asks"), own(y).alias("y"), every(x).alias("x"))

    def near(met: pa.Table) -> pa.Table:
        asks, ids = met["asks"].to_numpy(), met["id"].to_numpy()
        vectors = met["v"].combine_chunks()
        dims = vectors.value_lengths().to_numpy()
        b = np.flatnonzero(~asks)
        b = b[np.argsort(ids[b], kind="stable")]
        of_dim = {d: (at := np.flatnonzero(dims[b] == d), _matrix(vectors, b[at])) for d in np.unique(dims[b]).tolist()}
        lengths = {d: np.sqrt((m * m).sum(axis=1)) for d, (_, m) in of_dim.items()}
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for d in np.unique(dims[asks]).tolist():
            mine = np.flatnonzero(asks & (dims == d))
            for at in range(0, len(mine) if len(b) else 0, _TILE):
                some = mine[at : at + _TILE]
                m = _matrix(vectors, some)
                score = np.zeros((len(some), len(b)))  # 0 for vectors of other lengths and zero vectors
                if d in of_dim:
                    norms = np.sqrt((m * m).sum(axis=1))[:, None] * lengths[d][None]
                    score[:, of_dim[d][0]] = np.divide(m @ of_dim[d][1].T, norms, out=np.zeros_like(norms), where=norms > 0)
                rounded = np.round(score, 6)
                rounded[ids[some][:, None] == ids[b][None]] = -np.inf
                for i in range(len(some)):
                    best = _first(rounded[i], k)
                    best = best[np.isfinite(rounded[i][best])]
                    out.append((np.full(len(best), ids[some[i]]), ids[b[best]], score[i][best]))
        return pa.table(dict(zip(("query_id", "id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    found = asking.unionByName(asked).groupBy("x", "y").applyInArrow(near, "query_id long, id long, score double")
    if n_q_odd or n_odd:
        pairs = rows.join(q.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("plain").alias("q_plain")), F.col("id") != F.col("query_id")).where("NOT plain OR NOT q_plain")
        found = found.unionByName(pairs.select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score")))
    return top_k(found.select("query_id", "id", F.round("score", 6).alias("score")), k)


def _marked(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, plain): plain vectors are those that products of matrices can compare."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).where("id IS NOT NULL")
    return rows.withColumn("plain", F.coalesce(F.forall("v", lambda x: F.coalesce(F.abs(x) < _HUGE, F.lit(False))), F.lit(False)))


def _matrix(vectors: pa.ListArray, rows: np.ndarray) -> np.ndarray:
    taken = vectors.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, the first ones among equals."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate((above, np.flatnonzero(scores == least)[: k - len(above)]))


def similarity_links(vectors: DataFrame, least: float, id_col: str = "vec_id", vector_col: str = "embedding", block: int = _BLOCK) -> DataFrame:
    """(a, b): links that join what the pairs of all rows at cosine `least` (over 0) or more join.

    Exact: every pair of blocks meets in a group, and of its pairs a spanning forest is
    returned, so that what leaves a group grows with its rows and no partner is dropped.
    Cosines are rounded to six digits. Null, zero and non-finite vectors and null ids have no links.
    """
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    blocks = max(1, math.ceil(rows.count() / block))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select("id", "v", "own", F.size("v").alias("dim"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def links(met: pa.Table) -> pa.Table:
        own = met["own"].to_numpy()
        order = np.argsort(own, kind="stable")
        ids, own = met["id"].to_numpy()[order], own[order]
        x = met["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        scale = np.abs(x).max(axis=1, keepdims=True)
        good = (np.isfinite(x).all(axis=1) & (scale[:, 0] > 0)).nonzero()[0]
        ids, own, x = ids[good], own[good], x[good] / scale[good]
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        within = len(own) == 0 or met["x"][0].as_py() == met["y"][0].as_py()
        split = 0 if within else int((own == own[0]).sum()) if own[0] == met["x"][0].as_py() else 0
        group = np.arange(len(ids))
        for at in range(0, len(ids) if within else split, _TILE):
            upto = min(at + _TILE, len(ids) if within else split)
            near = np.round(unit[at:upto] @ unit[split:].T, 6) >= least
            for i, row in enumerate(near, start=at):
                mine = np.unique(group[split:][row & (ids[split:] != ids[i])])
                if len(mine) and (len(mine) > 1 or mine[0] != group[i]):
                    mine = np.append(mine, group[i])
                    group[np.isin(group, mine)] = mine.min()
        apart = (group != np.arange(len(ids))).nonzero()[0]
        return pa.table({"a": ids[group[apart]], "b": ids[apart]})

    return rows.groupBy("dim", "x", "y").applyInArrow(links, "a long, b long").where("a <> b").distinct()
