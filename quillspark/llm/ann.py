"""Approximate nearest neighbours by multiprobe p-stable hashing."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import stored
from quillspark.llm.vectors import best_rows, classes, is_query, matrix, usable

_BLOCK = 2048  # vectors of a bucket compared in one group
_MARGIN = 0.02  # by which a kth cosine may be lower than the search was made for


class Hashes:
    """Tables of floor((a.x + b) / width) over unit vectors, a standard normal, b uniform."""

    def __init__(self, dim: int, tables: int, per_table: int, width: float, near: float, seed: int = 11) -> None:
        rng = np.random.default_rng([seed, dim])
        self.a = rng.standard_normal((tables, dim, per_table))
        self.b = rng.uniform(0, width, (tables, per_table))
        self.width, self.near = width, min(max(near, 0.0), 0.999)

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        return np.floor((unit @ self.a[table] + self.b[table]) / self.width).astype(np.int64)

    def probes(self, unit: np.ndarray, table: int, near: float, mass: float, most: int) -> Iterator[tuple[int, ...] | None]:
        """Cells by the estimated chance that a neighbour at cosine `near` lies in them, until
        the chances sum to `mass`: its projection is normal around near * a.q. None comes last
        if `most` cells are not enough."""
        near = min(max(near, 0.0), 0.999)
        centre = near * (unit @ self.a[table])
        spread = math.sqrt(1 - near**2)
        choices: list[list[tuple[float, int]]] = []
        for c, b in zip(centre.tolist(), self.b[table].tolist(), strict=True):
            low, high = (math.floor((c + s * 4 * spread + b) / self.width) for s in (-1, 1))
            edges = [_normal(((cell * self.width - b) - c) / spread) for cell in range(low, high + 2)]
            options = [(-math.log(max(q - p, 1e-12)), low + i) for i, (p, q) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            choices.append(sorted(options))
        start = (0,) * len(choices)
        heap, seen, got, n = [(sum(c[0][0] for c in choices), start)], {start}, 0.0, 0
        while heap and got < mass and n < most:
            cost, at = heapq.heappop(heap)
            yield tuple(choices[i][j][1] for i, j in enumerate(at))
            got, n = got + math.exp(-cost), n + 1
            for i, j in enumerate(at):
                if j + 1 < len(choices[i]):
                    after = (*at[:i], j + 1, *at[i + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (cost + choices[i][j + 1][0] - choices[i][j][0], after))
        if heap and got < mass:
            yield None


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def _bucket(cells: np.ndarray | tuple[int, ...]) -> int:
    return xxhash.xxh64_intdigest(np.asarray(cells, dtype=np.int64).tobytes()) >> 1


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)  # tiny and huge components keep their direction
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def kth_cosine(vectors: DataFrame, dim: int, k: int, most: int) -> float:
    """Median cosine of the kth neighbour within a sample of about `most` vectors."""
    rows = vectors.where(F.col("dim") == dim)
    share = min(1.0, most / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("v"), F.lit(1_000_000)) < math.ceil(share * 1_000_000)).orderBy("least").limit(most)
    x = np.array([r.v for r in some.select("v").collect()], dtype=float).reshape(-1, dim)
    if len(x) < 2:
        return 0.9
    unit = _unit(x)
    near = unit[:512] @ unit.T
    near[np.arange(len(near)), np.arange(len(near))] = -2
    k = min(k, len(x) - 1)
    return float(np.median(np.partition(near, -k, axis=1)[:, -k]))


def search(rows: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 2, width: float = 4.0, mass: float = 0.8, sample: int = 4096, most_probes: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, the k rows
    of largest cosine among those its probes meet; ties go to the smaller id.

    The index takes every row; only the width of the first search is fitted, on a sample of at most
    `sample` vectors. Each table uses 8 hashes, more beyond 64 thousand distinct vectors. A
    query visits buckets in the order of their estimated chance until it reaches `mass` in each
    table; what the tables find is merged and ranked by the exact cosine in doubles. A query
    whose kth cosine is lower than the search was made for searches once more, as widely as that
    cosine asks for; one that still has fewer than k, or for which most_probes buckets don't reach
    `mass`, meets all rows in blocks. Buckets are dealt in blocks, so a full one is no single
    task. Equal vectors are one index entry, whatever their number. Vectors that are null, zero
    or hold null or non-finite components take no part, nor do rows without an id; vectors meet
    vectors of their own length. Rows that repeat id and vector count once; an id with several
    vectors is a row for each. Empty table: no rows.
    """
    usable_rows = usable(rows, id_col, vector_col, nonzero=True)
    vectors = stored(classes(usable_rows, k + 1))
    sizes = {r.dim: r["count"] for r in vectors.groupBy("dim").count().collect()}  # a row per length of vectors
    hashes = {d: Hashes(d, tables, max(8, round(math.log2(n / 4096)) + 4), width, kth_cosine(vectors, d, k, sample)) for d, n in sizes.items()}
    asked = usable_rows.where(is_query(every)).join(vectors.select("v", F.col("cid").alias("qcid")), "v").select("vec_id", "qcid", "v", "dim")
    asked = stored(asked)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == d))
                unit = _unit(matrix(some.column("v"), d))
                for t in range(tables):
                    buckets = np.fromiter((_bucket(c) for c in hashes[d].cells(unit, t)), dtype=np.int64, count=len(unit))
                    yield pa.RecordBatch.from_arrays([some.column("cid"), some.column("least"), some.column("v"), pa.array(np.full(len(unit), d * tables + t, np.int64)), pa.array(buckets)], names=["cid", "least", "v", "t", "bucket"])

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (b.slice(at, 64) for at in range(0, b.num_rows, 64)):
                out = []
                for cid, v, d, near in zip(*(some.column(c).to_pylist() for c in ("qcid", "v", "dim", "near")), strict=True):
                    unit = _unit(np.array([v]))[0]
                    out += [(cid, v, d * tables + t, -1 if c is None else _bucket(c)) for t in range(tables) for c in hashes[d].probes(unit, t, near, mass, most_probes)]
                kinds = (pa.int64(), pa.list_(pa.float64()), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["qcid", "v", "t", "bucket"])

    entries = stored(vectors.select("cid", "least", "v", "dim").mapInArrow(index, "cid long, least long, v array<double>, t long, bucket long"))
    full = entries.groupBy("t", "bucket").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    entries = entries.join(full, ["t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"qcid": pa.array([], pa.int64()), "cid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        dim = len(mine["v"][0])
        x, q = matrix(mine["v"], dim), matrix(theirs["v"], dim)
        out = nearest(q, theirs["qcid"].to_numpy(), x, mine["cid"].to_numpy(), mine["least"].to_numpy(), k + 1)
        return pa.table(dict(zip(("qcid", "cid", "score"), out, strict=True)))

    def probed(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(qcid, cid, score) of queries (qcid, v, dim, near), and the queries whose probes did not suffice."""
        sent = stored(some.mapInArrow(visits, "qcid long, v array<double>, t long, bucket long"))
        met = sent.join(full.toDF("t", "bucket", "blocks"), ["t", "bucket"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)))
        met = entries.groupBy("t", "bucket", "block").cogroup(met.groupBy("t", "bucket", "block")).applyInArrow(compare, "qcid long, cid long, score double")
        nth = F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), "cid"))
        return stored(met.distinct().withColumn("nth", nth).where(F.col("nth") <= 2 * (k + 1))), sent.where("bucket = -1").select("qcid").distinct()

    of_dim = F.create_map(*[x for d, h in hashes.items() for x in (F.lit(d), F.lit(h.near))]) if hashes else F.lit(None)
    first = asked.dropDuplicates(["qcid"]).select("qcid", "v", "dim", F.element_at(of_dim, F.col("dim")).alias("near") if hashes else F.lit(0.0).alias("near"))
    found, capped = probed(first)
    # rows of a class count one by one, and the query's own class is among them
    members = vectors.select("cid", F.size("ids").alias("n"))

    def kth(met: DataFrame) -> DataFrame:
        so_far = F.sum("n").over(Window.partitionBy("qcid").orderBy(F.desc("score"), "cid").rowsBetween(Window.unboundedPreceding, 0))
        ranked = met.join(members, "cid").withColumn("upto", so_far)
        return ranked.where(F.col("upto") > k).groupBy("qcid").agg(F.max("score").alias("kth"))

    again = first.join(kth(found), "qcid", "left").where(F.col("kth").isNull() | (F.col("kth") < F.col("near") - _MARGIN))
    more, capped_again = probed(again.withColumn("near", F.greatest(F.coalesce("kth", F.lit(0.0)), F.lit(0.0))).select("qcid", "v", "dim", "near"))
    found = found.select("qcid", "cid", "score").union(more.select("qcid", "cid", "score")).distinct()
    short = first.join(kth(found), "qcid", "left").where("kth IS NULL").select("qcid").union(capped).union(capped_again).distinct()
    rest = first.join(short, "qcid", "left_semi").select("qcid", "v", "dim")
    blocks = vectors.groupBy("dim").agg(F.ceil(F.count("*") / _BLOCK).cast("long").alias("blocks"))
    own = vectors.join(blocks, "dim").select("cid", "least", "v", "dim", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"))
    rest = rest.join(blocks.toDF("dim", "blocks"), "dim").select("qcid", "v", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    whole = own.groupBy("dim", "block").cogroup(rest.groupBy("dim", "block")).applyInArrow(compare, "qcid long, cid long, score double")
    return best_rows(found.union(whole), vectors, asked, k, "double")


def nearest(q: np.ndarray, qids: np.ndarray, x: np.ndarray, cids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, class, cosine) of each query's k best, by exact cosines; ties go to the smaller id."""
    order = np.lexsort((cids, ids))
    x, ids, cids = x[order], ids[order], cids[order]
    unit, asked = _unit(x), _unit(q)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 256):
        close = asked[at : at + 256] @ unit.T
        keep = min(len(x), k)
        last = np.partition(close, len(x) - keep, axis=1)[:, len(x) - keep]
        for i, row in enumerate(close, start=at):
            some = np.flatnonzero(row >= last[i - at] - 1e-9)  # all that tie, and the last digits of the product
            score = cosines(q[i], x[some])
            top = np.lexsort((ids[some], -score))[:k]
            out.append((np.full(len(top), qids[i]), cids[some][top], score[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of one vector with the rows of x, each row by itself, so that equal rows are equal."""
    scale_q, scale_x = np.abs(q).max(), np.abs(x).max(axis=1, keepdims=True)
    q, x = (q / scale_q, x / scale_x) if not 1e-100 < scale_q < 1e100 or scale_x.min() < 1e-100 or scale_x.max() > 1e100 else (q, x)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
