"""Readers of tables and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions.text import links, plain_html, resolved


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "html", "csv", "json")) -> DataFrame:
    """(path, text): files with an allowed extension."""
    out = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return out.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def delimited(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A delimited file with every cell as text."""
    return spark.read.csv(path, sep=delimiter, header=True, inferSchema=False, multiLine=True, escape='"')


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, nth, target): http links as seen from the page's url, without fragment, each once by its
    first occurrence; other schemes are skipped."""
    rows = pages.select("page_id", "url", F.posexplode(links(F.col("html"))).alias("pos", "href"))
    rows = rows.withColumn("target", resolved(F.col("url"), F.col("href"))).where("target IS NOT NULL")
    first = rows.groupBy("page_id", "target").agg(F.min("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return first.select("page_id", nth.alias("nth"), "target")


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, title, text): the plain form of each page."""
    title: Column = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return pages.select("page_id", title.alias("title"), plain_html(F.col("html")).alias("text"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): created, deleted or changed between two snapshots."""
    a, b = before.select(key, F.col(digest).alias("old")), after.select(key, F.col(digest).alias("new"))
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")
