"""Statistics and types of columns that hold text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.functions.cells import is_blank, is_bool, is_derived_label, is_id_like, iso_date, number, votes_for_comma

_LITERALS = 1000


def long_form(table: DataFrame) -> DataFrame:
    """(name, cell): every cell as text, without a shuffle."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("cell")) for c in table.columns]))
    return table.select(cells.alias("x")).select("x.*")


def column_statistics(table: DataFrame) -> DataFrame:
    """A row per column: counts of filled, numeric, date, boolean, id-like and distinct cells."""
    cell = F.col("cell")
    filled = ~is_blank(cell)

    def many(test: Column) -> Column:
        return F.count(F.when(filled & test, 1))

    counted = long_form(table).groupBy("name").agg(
        F.count("*").alias("n"), many(F.lit(True)).alias("filled"), many(number(cell).isNotNull()).alias("numeric"), many(iso_date(cell).isNotNull()).alias("dates"),
        many(is_bool(cell)).alias("bools"), many(is_id_like(cell)).alias("ids"), F.countDistinct(F.when(filled, cell)).alias("n_distinct"),
    )
    return counted


def column_types(statistics: DataFrame) -> DataFrame:
    """(name, type): columns with ids that are no numbers are text; else boolean, date or numeric if all filled cells are; else text."""
    f = F.col("filled")
    kind = F.when((f == 0) | ((F.col("ids") > 0) & (F.col("numeric") < f) & (F.col("dates") < f)), "text").when(F.col("bools") == f, "boolean").when(F.col("dates") == f, "date").when(F.col("numeric") == f, "numeric").otherwise("text")
    return statistics.select("name", kind.alias("type"))


def value_index(table: DataFrame, columns: list[str], longest: int = 512) -> DataFrame:
    """(name, cell, n): rows with each value of text columns; longer values are left out."""
    rows = long_form(table.select(*columns)).where(~is_blank(F.col("cell")) & (F.octet_length("cell") <= longest))
    return rows.groupBy("name", "cell").agg(F.count("*").alias("n"))


def look_up(index: DataFrame, literals: DataFrame, most: int) -> DataFrame:
    """(literal, name, cell, kind): values equal to (0), starting with (1) or holding (2) each literal
    of two characters or more; the `most` best, more frequent values first. literals are a question's, a few."""
    if literals.count() > _LITERALS:
        raise ValueError(f"more than {_LITERALS} literals")
    few = F.broadcast(literals.where(F.char_length("literal") >= 2))
    value, literal = F.lower("cell"), F.lower("literal")
    kind = F.when(value == literal, 0).when(F.startswith(value, literal), 1).otherwise(2)
    found = index.join(few, F.contains(value, literal)).withColumn("kind", kind)
    nth = F.row_number().over(Window.partitionBy("literal").orderBy("kind", F.desc("n"), "name", "cell"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most).select("literal", "nth", "name", "cell", "kind", "n")


def coercion_failures(table: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(name, failures): filled cells of each column that its kind ("numeric" or "date") can't read."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("cell"), F.lit(k).alias("kind")) for c, k in kinds.items()])
    rows = table.select(F.explode(cells).alias("x")).select("x.*")
    read = F.when(F.col("kind") == "numeric", number(F.col("cell")).isNotNull()).otherwise(iso_date(F.col("cell")).isNotNull())
    return rows.groupBy("name").agg(F.count_if(~is_blank(F.col("cell")) & ~read).alias("failures"))


def decimal_comma(table: DataFrame) -> DataFrame:
    """(name, comma): whether more cells of a column read as decimal commas than as points."""
    return long_form(table).groupBy("name").agg((F.sum(votes_for_comma(F.col("cell"))) > 0).alias("comma"))


def column_roles(statistics: DataFrame, most_values: int = 50) -> DataFrame:
    """(name, role): id, date (90 % of filled cells), boolean (two values at most), measure (90 %), category, text."""
    f = F.col("filled")
    role = F.when(f == 0, "text").when((F.col("ids") * 2 > f) & (F.col("numeric") < f), "id").when(F.col("dates") >= 0.9 * f, "date").when((F.col("bools") == f) & (F.col("n_distinct") <= 2), "boolean")
    role = role.when(F.col("numeric") >= 0.9 * f, "measure").when((F.col("n_distinct") <= most_values) & (F.col("n_distinct") * 2 <= f), "category").otherwise("text")
    return statistics.select("name", role.alias("role"))


def data_rows(table: DataFrame, sheet: str, label: str, order: list[str]) -> DataFrame:
    """Rows that hold something and aren't totals, numbered by _rowid from 1 in each sheet."""
    filled = [~is_blank(F.col(c).cast("string")) for c in table.columns if c != sheet]
    rows = table.where(reduce(lambda a, b: a | b, filled)).where(~is_derived_label(F.col(label).cast("string")))
    return rows.withColumn("_rowid", F.row_number().over(Window.partitionBy(sheet).orderBy(*order)))


def chart(table: DataFrame, x: str, y: str | None, how: str, limit: int = 50) -> DataFrame:
    """(x, y): count, sum, avg, min or max by x, counts largest first, others by x; limit rows at most."""
    agg = {"count": F.count("*"), "sum": F.sum(y or x), "avg": F.avg(y or x), "min": F.min(y or x), "max": F.max(y or x)}[how]
    out = table.groupBy(F.col(x).alias("x")).agg(agg.alias("y"))
    return (out.orderBy(F.desc("y"), "x") if how == "count" else out.orderBy("x")).limit(limit)
