"""Helpers shared by the operators: scratch tables, whole-table reads, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the cluster names none (tests), the warehouse folder is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/quillspark-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files when they end, not at some later collection."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    return _write(df, scratch_path(df.sparkSession))


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that go when the block ends, or when `drop` names them. What a caller gets
    has to be stored outside of it, or be collected before."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n, self.paths = spark, scratch_path(spark), 0, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.root)

    def stored(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        out = _write(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            self._delete(self.paths.pop(id(t))[1])

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links between longs -> (node, component), component the smallest node reachable.

    Alternating large-star and small-star steps; each step rewrites the edge table
    so that every node points at a smaller neighbour, until only stars are left.
    Self links are allowed and keep a lone node.
    """
    with Scratch(edges.sparkSession) as scratch:
        first = edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        edges = first = scratch.stored(first)
        before = None
        while True:
            new = scratch.stored(_small_star(_large_star(edges)))
            if edges is not first:
                scratch.drop(edges)
            edges = new
            # the edge set is a set of stars once a round leaves it as it was
            mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if mark == before:
                break
            before = mark
        nodes = first.select(F.col("u").alias("node")).union(first.select(F.col("v").alias("node"))).distinct()
        roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        return stored(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # neighbours are all smaller here; those and the node itself move to the least one
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
