"""What the vector searches share: distinct vectors, blocks, and expanding results to rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def usable(rows: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, v, dim): rows with an id and a vector of finite components, as doubles."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    out = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    out = out.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(finite)
    if nonzero:
        out = out.where(F.exists("v", lambda x: x != 0))
    return out.withColumn("dim", F.size("v"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(cid, v, dim, ids, least): one row per distinct vector with its `keep` smallest ids. cid is a number
    of its own for each vector, whatever ids it shares with others: the table has to be stored.

    A ranking that needs `keep` rows never needs more of equal vectors; the limit by rank is
    applied before the shuffle too, so a vector of very many rows isn't gathered.
    """
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.dropDuplicates(["vec_id", "v"]).withColumn("nth", nth).where(F.col("nth") <= keep)
    out = few.groupBy("v", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return out.select(F.monotonically_increasing_id().alias("cid"), "v", "dim", "ids", F.col("ids")[0].alias("least"))


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0


def best_rows(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from (qcid, cid, score): classes become their rows, the
    query's own row goes, and k stay, by score and then id. An id with several vectors is a row
    for each of them, as a candidate and as a query."""
    first = F.row_number().over(Window.partitionBy("qcid").orderBy(F.desc("score"), "vec_id", "cid"))
    rows = found.distinct().join(vectors.select("cid", "ids"), "cid").select("qcid", "cid", "score", F.explode("ids").alias("vec_id"))
    of_class = queries.select(F.col("vec_id").alias("query_id"), "qcid").distinct()
    # one row more than asked for: a query's own row is among them at most once
    rows = rows.withColumn("nth", first).where(F.col("nth") <= k + 1).drop("nth")
    rank = F.row_number().over(Window.partitionBy("query_id", "qcid").orderBy(F.desc("score"), "vec_id"))
    out = of_class.join(rows, "qcid").where("vec_id <> query_id OR cid <> qcid").withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type).alias("score"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as a matrix with dim columns."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
