"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of all hashes, however long the
text is, so that sketches of very unequal documents can be compared and merged; of a short
text it keeps the `least` smallest. Nothing but built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOWEST = -(1 << 63)  # hashes are signed longs, evenly spread from here
_HIGHEST = (1 << 63) - 1


def _limit(fraction: float) -> int:
    return _LOWEST + int(fraction * 2**64)


def words(text: Column) -> Column:
    """Lower-cased, between ASCII white space."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(of: Column, width: int) -> Column:
    """The hash of every run of `width` words; fewer words: of them all; no word: no hash."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(of) - width + 1, F.lit(1)))
    return F.when(F.size(of) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(of, i, width)))).otherwise(F.array().cast("array<bigint>"))


def retained(hashes: Column, below: Column, least: int) -> Column:
    """The sorted distinct hashes below the limit, or the `least` smallest, whichever are more."""
    return F.when(F.size(below) >= least, below).otherwise(F.slice(F.array_sort(F.array_distinct(hashes)), 1, least))


def sketched(df: DataFrame, text: str, out: str, width: int, fraction: float, least: int) -> DataFrame:
    """df with the sketch of column text as sorted array<long>."""
    limit = _limit(fraction)
    df = df.withColumn("__words", words(F.col(text)))
    df = df.withColumn("__hashes", shingle_hashes(F.col("__words"), width)).drop("__words")
    df = df.withColumn("__below", F.array_sort(F.array_distinct(F.filter("__hashes", lambda h: h < F.lit(limit)))))
    return df.withColumn(out, retained(F.col("__hashes"), F.col("__below"), least)).drop("__hashes", "__below")


def merge(a: Column, b: Column, fraction: float, least: int) -> Column:
    """The sketch of two texts' shingles together, from their sketches alone."""
    both = F.array_sort(F.array_union(a, b))
    return retained(both, F.filter(both, lambda h: h < F.lit(_limit(fraction))), least)


def _complete_to(sketch: Column, fraction: float, least: int) -> Column:
    """Up to which hash a sketch holds all that its text has."""
    last = F.coalesce(F.element_at(F.slice(sketch, F.greatest(F.size(sketch), F.lit(1)), 1), 1), F.lit(_LOWEST))
    return F.when(F.size(sketch) < least, F.lit(_HIGHEST)).otherwise(F.greatest(last, F.lit(_limit(fraction) - 1)))


def containment(a: Column, b: Column, fraction: float, least: int) -> Column:
    """The estimated share of the smaller text's shingles that the other has, 0 to 1: over the
    hashes up to which both sketches are complete. Equal sketches, empty ones too: 1."""
    to = F.least(_complete_to(a, fraction, least), _complete_to(b, fraction, least))
    x, y = (F.filter(s, lambda h: h <= to) for s in (a, b))
    fewer = F.least(F.size(x), F.size(y))
    share = F.size(F.array_intersect(x, y)) / fewer
    return F.when(a == b, 1.0).when(fewer == 0, 0.0).otherwise(share).cast("double")


def shown(sketch: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits a hash, in ascending order of signed longs."""
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _part(id_: Column, bounds: list[int]) -> Column:
    """How many bounds are below an id, in two steps; null: -1."""
    if not bounds:
        return F.when(id_.isNull(), -1).otherwise(0)
    step = math.isqrt(len(bounds)) + 1
    all_, coarse = F.lit(bounds), F.lit(bounds[step - 1 :: step])
    passed = lambda xs: F.size(F.filter(xs, lambda b: b < id_))
    skipped = passed(coarse) * step
    return F.when(id_.isNull(), -1).otherwise(skipped + passed(F.slice(all_, skipped + 1, step)))


def with_next(docs: DataFrame, columns: list[str], order: list[Column], parts: int) -> DataFrame:
    """docs (id, ...) with each of `columns` of the next row by descending id, null ids last, equal
    ids by `order`, as next_<column>; the last row's next is the first.

    Rows are dealt into ranges of ids, each sorted in a task of its own; at most `parts` bounds
    and first ids go through the driver or a broadcast. The first row of each range, which the last
    row of the range before needs, is read in a pass of its own.
    """
    shares = [i / parts for i in range(1, parts)]
    found = docs.agg(F.percentile_approx("id", shares, 10_000).alias("b")).first()["b"] if shares else None
    docs = docs.withColumn("part", _part(F.col("id"), sorted(set(found or []))))
    firsts = docs.groupBy("part").agg(F.max("id").alias("first"))
    links = firsts.select("part", F.coalesce(F.lag("part").over(Window.orderBy("part")), F.max("part").over(Window.partitionBy())).alias("after"))
    heads = docs.join(F.broadcast(firsts.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("id").eqNullSafe(F.col("first")))
    heads = heads.groupBy("part").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("head"))
    tails = links.join(heads.withColumnRenamed("part", "after"), "after").select("part", "head")
    in_part = Window.partitionBy("part").orderBy(F.desc_nulls_last("id"), *order)
    led = docs.withColumn("__next", F.lead(F.struct(*columns)).over(in_part)).join(tails, "part", "left")
    following = F.coalesce("__next", "head")
    return led.select(*(c for c in docs.columns if c != "part"), *(following[c].alias(f"next_{c}") for c in columns))


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, fraction: float = 1 / 8, least: int = 16, parts: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per row of docs.

    The edited text is the text with its last half (rounded down, code points) replaced by as
    many, or all, first code points of the next document by descending id. near_* are
    containments (see above) of the text's sketch with the edited text's and the next document's.

    Null text is empty: no shingle, an empty fingerprint, which is like another empty one and
    unlike any other. Null ids come last; rows of one id are ordered by the MD5 of their text, in
    one task, which sorts with spill. Repeated rows follow one another, so a copy's next is
    its copy. A single row's next is itself. Other columns are not read. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = sketched(texts, "text", "sketch", width, fraction, least)
    pairs = with_next(own, ["text", "sketch"], [F.md5("text")], parts)
    pairs = pairs.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = pairs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = sketched(pairs.select("id", "n_chars", "sketch", "next_sketch", "edited"), "edited", "edited_sketch", width, fraction, least)
    near = lambda other: containment(F.col("sketch"), F.col(other), fraction, least)
    return pairs.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), shown(F.col("sketch")).alias("fingerprint"), shown(F.col("edited_sketch")).alias("edited_fingerprint"), near("edited_sketch").alias("near_edited"), near("next_sketch").alias("near_next"))
