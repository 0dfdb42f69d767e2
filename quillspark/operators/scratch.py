"""Tables that an iterative operator writes between its rounds, in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

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


def _to_ipc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
            to.write_batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["rows"])


def _from_ipc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rows in b.column(0):
            yield from pa.ipc.open_stream(rows.as_buffer())


class Rounds:
    """Written tables that are deleted when the block ends.

    They are below spark.checkpoint.dir; where no cluster names it, the session's checkpoint
    folder or a folder of the warehouse is taken. What a caller gets is made by result(), a
    checkpoint, which Spark removes itself when nothing refers to it any more
    (spark.cleaner.referenceTracking.cleanCheckpoints).
    """

    def __init__(self, spark: SparkSession) -> None:
        context = spark.sparkContext
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if not context.getCheckpointDir():
            context.setCheckpointDir(base)
        self.spark, self.root, self.n, self.paths = spark, f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0, {}

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, *_: object) -> None:
        self._delete(self.root)

    def keep(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """df, written once and read from there: its lineage ends, and a lost executor costs nothing. `by` names a
        column whose values are stored apart."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with _shuffles_removed(self.spark):
            df.write.parquet(path, partitionBy=by)
        out = self.spark.read.schema(df.schema).parquet(path).select(df.columns)
        self.paths[id(out)] = out, path
        return out

    def drop(self, table: DataFrame, part: str = "") -> None:
        """Delete a kept table that nothing reads any more, or its part "column=value"."""
        path = self.paths[id(table)][1]
        self._delete(f"{path}/{part}" if part else path)

    def result(self, df: DataFrame, packed: bool = False) -> DataFrame:
        """df, free of the tables kept here. Packed, the checkpoint holds compressed batches, as Spark's own aren't."""
        kept = self.keep(df)
        return kept.mapInArrow(_to_ipc, "rows binary").checkpoint().mapInArrow(_from_ipc, kept.schema) if packed else kept.checkpoint()

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
