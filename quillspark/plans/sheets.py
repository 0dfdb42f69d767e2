"""Sheets laid out from customers, a sheet for each nation, and what is found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.operators import sheets
from quillspark.operators.scratch import Rounds
from quillspark.plans.registry import Registry
from quillspark.sources.tables import read

REGISTRY = Registry()
query = REGISTRY.query


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title, a header of two columns groups with a blank column between, data with a blank row after
    each twenty rows, and in every third sheet a list of its own at the right."""
    rows = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    i = F.row_number().over(Window.partitionBy("n_nationkey").orderBy("c_custkey")) - 1
    rows = rows.withColumn("i", i).withColumn("row", 3 + F.col("i") + F.floor(F.col("i") / 20).cast("int"))

    def cell(row: Column, col: int, raw: Column, kind: str, styled: bool = False) -> Column:
        return F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), raw.cast("string").alias("raw"), F.lit(kind).alias("kind"), F.lit(styled).alias("styled"))

    at = F.col("row")
    data = [cell(at, 0, F.col("c_name"), "text"), cell(at, 1, F.col("c_custkey"), "number"), cell(at, 3, F.col("c_mktsegment"), "text"), cell(at, 4, F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")), "number"), cell(at, 7, F.when((F.col("n_nationkey") % 3 == 0) & (F.col("i") < 5), F.col("c_mktsegment")), "text")]
    head = [cell(F.lit(2), c, F.lit(t), "text", True) for c, t in ((0, "Customer"), (1, "Key"), (3, "Segment"), (4, "Balance"))] + [cell(F.lit(0), 0, F.concat(F.lit("Customers of "), F.col("n_name")), "text")]
    below = rows.select(F.col("n_name").alias("sheet"), F.explode(F.array(*data)).alias("x"))
    above = read(spark, sf_dir, "nation").select(F.col("n_name").alias("sheet"), F.explode(F.array(*head)).alias("x"))
    return below.union(above).select("sheet", "x.*").where("raw IS NOT NULL")


@query()
def sheet_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.regions(_cells(spark, sf_dir))


@query()
def sheet_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region's kind and, where it has a header, its place and column names."""
    region = ["sheet", "top", "left"]
    with Rounds(spark) as rounds:  # each is read several times
        cells = rounds.keep(_cells(spark, sf_dir))
        found = rounds.keep(sheets.regions(cells))
        heads = rounds.keep(sheets.headers(cells, found))
        names = rounds.keep(sheets.header_names(cells, found, heads))
        return rounds.result(_described(sheets.kinds(cells, found, heads, names), heads, names, region))


def _described(kinds: DataFrame, heads: DataFrame, names: DataFrame, region: list[str]) -> DataFrame:
    names = names.groupBy(*region).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "name"))), lambda x: x["name"]), "|").alias("names"))
    return kinds.join(heads.select(*region, F.array_join("header_rows", ",").alias("header_rows"), "data_start"), region, "left").join(names, region, "left")
