"""Profiles of a sheet's columns: counts by kind, ranges, samples and frequent values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions.cells import DATE_LAYOUTS, TIME_LAYOUTS, is_blank, is_null_token, number
from quillspark.functions.questions import injection_suspect
from quillspark.operators.scratch import Rounds

# fixed values: cells that stand for true and false
BOOLEANS = ("ja", "yes", "true", "x", "✓", "wahr", "nein", "no", "false", "falsch")
# fixed value: names of columns that hold identifiers
ID_NAMES = r"(?i)\b(nr|nummer|no|id|code|kennung|beleg|material|artikel|plz|schl(ü|ue)ssel|key|gis)\b|\bnr\."
# fixed value: digits and further segments
SEGMENTS = r"^[0-9]+([._\-/][0-9A-Za-z_]+)+$"
# how any of DATE_LAYOUTS and TIME_LAYOUTS begins
_LIKE_DATE = r"^([0-9]{4}[-/]|[0-9]{1,2}\.[0-9]{1,2}\.)"
_SIGNS = ("bools", "leading_zero", "long_digits", "digits", "ids")  # counted among a column's cells
_TEXTUAL = ("id", "category", "text")  # roles with a set of values


def iso_text(cell: Column) -> Column:
    """A date as yyyy-MM-dd or a time as yyyy-MM-ddTHH:mm:ss, by the first layout that fits; else null."""
    t = F.trim(cell)
    days = [F.when(t.rlike(f"^{p}$"), F.try_to_date(t, layout).cast("string")) for p, layout in DATE_LAYOUTS]
    times = [F.when(t.rlike(f"^{p}$"), F.date_format(F.try_to_timestamp(t, F.lit(layout)), "yyyy-MM-dd'T'HH:mm:ss")) for p, layout in TIME_LAYOUTS]
    return F.coalesce(*days, *times)


def number_text(x: Column) -> Column:
    """A number without trailing zeros; one with more than six decimals, or too large for them, as Spark prints it."""
    short = x.cast("decimal(38,6)")
    return F.when(short.cast("double") == x, F.regexp_replace(short.cast("string"), r"\.?0+$", "")).otherwise(x.cast("string"))


def canonical(raw: Column, comma: Column) -> tuple[Column, Column]:
    """(value, kind) of a trimmed cell: digits with a leading zero and more than 15 digits stay texts, then dates
    and times, then numbers in the column's decimal style; kind is text, date, time or number."""
    return read_as(raw, iso_text(raw), F.when(comma, number(raw, True)).otherwise(number(raw)))


def read_as(raw: Column, when: Column, x: Column) -> tuple[Column, Column]:
    """canonical() of a cell whose date or time and number are known."""
    kept = raw.rlike("^(0[0-9]+|[0-9]{16,})$")
    value = F.when(kept, raw).when(when.isNotNull(), when).when(x.isNotNull(), number_text(x)).otherwise(raw)
    kind = F.when(kept, "text").when(F.contains(when, F.lit("T")), "time").when(when.isNotNull(), "date").when(x.isNotNull(), "number").otherwise("text")
    return value, kind


def _role() -> Column:
    """Of a column's counts: id by name, digits with leading zeros, more than 15 digits, segments in four fifths of the
    cells, codes of one width (4 or more digits, three or more, nine tenths of them distinct) or the numbers 1 to n in
    any order; date from nine tenths; boolean of two values; measure from nine tenths; category of at most 50 values
    that are no more than a fifth of the cells, or three; else text."""
    n, distinct = F.col("filled"), F.col("values")
    codes = (F.col("digits") == n) & (F.col("w0") == F.col("w1")) & (F.col("w0") >= 4) & (n >= 3) & (distinct >= 0.9 * n)
    numbered = (F.col("digits") == n) & (distinct == n) & (F.col("x0") == 1) & (F.col("x1") == n)
    is_id = F.col("name").rlike(ID_NAMES) | (F.col("leading_zero") > 0) | (F.col("long_digits") > 0) | (F.col("ids") >= 0.8 * n) | codes | F.coalesce(numbered, F.lit(False))
    out = F.when(n == 0, "text").when(is_id, "id").when(F.col("dates") + F.col("times") >= 0.9 * n, "date").when((n >= 2) & (F.col("bools") == n) & (F.col("bool_kinds") <= 2), "boolean")
    return out.when(F.col("numeric") >= 0.9 * n, "measure").when((n >= 5) & (distinct <= 50) & (distinct <= F.greatest(F.lit(3.0), 0.2 * n)), "category").otherwise("text")


def _values(table: DataFrame, columns: list[str], commas: tuple[str, ...], longest: int) -> DataFrame:
    """A row per column and value: (name, value, filled, kind), n cells, null_tokens, cells by sign (_SIGNS), least and
    largest width, the number x, and whether it fits into `longest` bytes."""
    melted = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(f"`{c}`").cast("string")).alias("raw")) for c in columns]))
    cells = table.select(melted.alias("x")).select("x.*")
    counted = cells.groupBy("name", "raw").agg(F.count("*").alias("n")).withColumn("filled", ~is_blank(F.col("raw")))
    # dates and numbers in projections of their own: the choices below read them, and try no layout twice
    raw, comma = F.col("raw"), F.col("name").isin(*commas)
    maybe = F.col("filled") & raw.rlike(_LIKE_DATE)
    counted = counted.withColumns({"when": F.when(maybe, iso_text(raw)), "point": F.when(F.col("filled"), number(raw)), "decimal": F.when(F.col("filled"), number(raw, True))})
    value, kind = read_as(raw, F.col("when"), F.when(comma, F.col("decimal")).otherwise(F.col("point")))
    read = counted.withColumns({"value": F.when(F.col("filled"), value), "kind": F.when(F.col("filled"), kind), "token": F.coalesce(is_null_token(F.col("raw")), F.lit(False))})
    segments = (F.col("kind") == "text") & F.col("point").isNull() & F.col("decimal").isNull() & raw.rlike(SEGMENTS)
    signs = (F.lower(raw).isin(*BOOLEANS), raw.rlike("^0[0-9]+$"), raw.rlike("^[1-9][0-9]{15,}$"), raw.rlike("^[0-9]+$"), segments)
    of_value = [F.sum(F.when(test & F.col("filled"), F.col("n")).otherwise(0)).alias(sign) for sign, test in zip(_SIGNS, signs, strict=True)]
    width = [F.min(F.char_length("raw")).alias("w0"), F.max(F.char_length("raw")).alias("w1")]
    values = read.groupBy("name", "value", "filled", "kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("token"), F.col("n")).otherwise(0)).alias("null_tokens"), *of_value, *width)
    return values.withColumn("x", F.when(F.col("kind") == "number", F.col("value").cast("double"))).withColumn("fits", F.octet_length("value") <= longest)


def column_profiles(table: DataFrame, order: str, commas: tuple[str, ...] = (), most_distinct: int = 10_000, longest: int = 512, most_values: int = 50, samples: int = 3) -> DataFrame:
    """A row per column of `table` but `order`, which numbers its rows.

    (name, role, n, nulls, null_tokens, numeric, dates, times, bools, texts, leading_zero,
    long_digits, low, high, n_distinct, overflow, long_values, samples, value_set)

    role is decided by _role. Blank cells and null tokens hold no value; nulls counts both, null_tokens the latter alone.
    low and high are the range of the numbers, else of the dates and times. Columns whose role is
    id, category or text count distinct values (in canonical form, of up to `longest` bytes;
    long_values counts cells beyond that) and list the most frequent ones, ties by value. Beyond
    `most_distinct` the list is null, n_distinct -1 and overflow true. samples are the first
    values in row order. Texts that tell a model what to do are in neither list. commas names the
    columns with decimal commas. A table without rows has no profile.

    Equal cells are counted before they are read, so that each distinct cell is classified once.
    """
    columns = [c for c in table.columns if c != order]

    def cells_where(test: str) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(test), F.col("n"))), F.lit(0))

    when = F.when(F.col("kind").isin("date", "time"), F.col("value"))
    stats = _values(table, columns, commas, longest).groupBy("name").agg(
        F.sum("n").alias("n"), cells_where("filled").alias("filled"), F.sum("null_tokens").alias("null_tokens"), cells_where("kind = 'number'").alias("numeric"), cells_where("kind = 'date'").alias("dates"), cells_where("kind = 'time'").alias("times"),
        cells_where("kind = 'text'").alias("texts"), *[F.sum(sign).alias(sign) for sign in _SIGNS], F.size(F.collect_set(F.when(F.col("bools") > 0, F.lower("value")))).alias("bool_kinds"),
        F.min(F.when(F.col("filled"), F.col("w0"))).alias("w0"), F.max(F.when(F.col("filled"), F.col("w1"))).alias("w1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min(when).alias("d0"), F.max(when).alias("d1"),
        F.count_if(F.col("filled")).alias("values"), F.count_if(F.col("filled") & F.col("fits")).alias("n_distinct"), cells_where("filled AND NOT fits").alias("long_values"),
    )
    with Rounds(table.sparkSession) as rounds:
        stats = rounds.keep(stats.withColumn("role", _role()))  # a row a column; the cells are counted once for it
        return rounds.result(_described(table, order, stats, commas, most_distinct, longest, most_values, samples))


def _described(table: DataFrame, order: str, stats: DataFrame, commas: tuple[str, ...], most_distinct: int, longest: int, most_values: int, samples: int) -> DataFrame:
    """The profiles: stats with frequent values, counted anew in the columns that list them, and samples."""
    columns = [c for c in table.columns if c != order]

    def cells_of(c: str) -> DataFrame:
        return table.select(F.lit(c).alias("name"), F.col(order).alias("at"), F.trim(F.col(f"`{c}`").cast("string")).alias("raw"))

    textual, over = F.col("role").isin(*_TEXTUAL), F.col("n_distinct") > most_distinct
    listed = [r["name"] for r in stats.where(textual & ~over).select("name").collect()]
    quiet = ~injection_suspect(F.col("value"))
    best = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("n"), "value"))
    values = _values(table, listed or columns[:1], commas, longest).where("filled AND fits").where(quiet)
    sets = values.withColumn("nth", best).where(F.col("nth") <= most_values)
    sets = sets.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "value"))), lambda s: s["value"]).alias("value_set"))
    # each column's first cells by a heap in every task; no cell is sorted or dealt out for them
    first = [cells_of(c).where(~is_blank(F.col("raw"))).orderBy("at", "raw").limit(samples) for c in columns]
    nth = F.row_number().over(Window.partitionBy("name").orderBy("at", "raw"))
    seen = reduce(DataFrame.unionByName, first).withColumn("nth", nth).where(~injection_suspect(F.col("raw")))
    seen = seen.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "raw"))), lambda s: s["raw"]).alias("samples"))
    none = F.array().cast("array<string>")
    boolean = F.col("role") == "boolean"
    out = stats.join(sets, "name", "left").join(seen, "name", "left")
    return out.select(
        "name", "role", "n", (F.col("n") - F.col("filled")).alias("nulls"), "null_tokens", "numeric", "dates", "times", F.when(boolean, F.col("filled")).otherwise(0).alias("bools"), F.when(boolean, 0).otherwise(F.col("texts")).alias("texts"),
        "leading_zero", "long_digits", F.coalesce(number_text(F.col("x0")), "d0").alias("low"), F.coalesce(number_text(F.col("x1")), "d1").alias("high"),
        F.when(textual & ~over, F.col("n_distinct")).otherwise(-1).alias("n_distinct"), (textual & over).alias("overflow"), "long_values",
        F.coalesce("samples", none).alias("samples"), F.when(textual & ~over, F.coalesce("value_set", none)).alias("value_set"),
    )
