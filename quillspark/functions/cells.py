"""Cells of spreadsheets: everything is text until its column's type is decided."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts that stand for no value; an empty cell is another thing
NULL_TOKENS = ("n/a", "na", "k.a.", "k. a.", "-", "–", "—", "entfällt", "#n/a", "#nv", "null", "none")
# fixed values: layouts of dates, in the order they are tried
DATE_LAYOUTS = (("[0-9]{4}-[0-9]{2}-[0-9]{2}", "yyyy-MM-dd"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4}", "dd.MM.yyyy"), (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "d.M.yyyy"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{2}", "dd.MM.yy"), ("[0-9]{4}/[0-9]{2}/[0-9]{2}", "yyyy/MM/dd"))
TIME_LAYOUTS = (("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy-MM-dd'T'HH:mm:ss"), ("[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}", "yyyy-MM-dd'T'HH:mm"), ("[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "yyyy-MM-dd HH:mm:ss"), (r"[0-9]{2}\.[0-9]{2}\.[0-9]{4} [0-9]{2}:[0-9]{2}", "dd.MM.yyyy HH:mm"))


def is_null_token(cell: Column) -> Column:
    return F.lower(F.trim(cell)).isin(*NULL_TOKENS)


def is_blank(cell: Column) -> Column:
    return cell.isNull() | (F.trim(cell) == "") | is_null_token(cell)


def is_id_like(cell: Column) -> Column:
    """Digits with a leading zero, more than 15 digits, or digits and further segments after . _ - or /.
    A plain decimal is one of the last kind too: its column's type is decided by counts."""
    return F.trim(cell).rlike(r"^(0[0-9]+|[0-9]{16,}|[0-9]+([._\-/][0-9A-Za-z_]+)+)$")


def number(cell: Column, decimal_comma: bool = False) -> Column:
    """The cell as a double, else null. Commas group digits and a point is the decimal sign, or the
    other way round. Digits with a leading zero and more than 15 digits are no numbers."""
    t = F.trim(cell)
    plain = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if decimal_comma else F.replace(t, F.lit(","), F.lit(""))
    ok = plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & ~t.rlike("^(0[0-9]+|[0-9]{16,})$")
    return F.when(ok, plain.try_cast("double"))


def votes_for_comma(cell: Column) -> Column:
    """1 if the cell reads as a decimal comma, -1 as a decimal point, else 0."""
    t = F.trim(cell)
    point, comma = number(t).isNotNull(), number(t, True).isNotNull()
    tail = F.char_length(F.element_at(F.split(t, ","), -1))
    by_shape = F.when((tail <= 2) & ~F.contains(t, F.lit(".")), 1).otherwise(-1)
    return F.when(F.coalesce(t, F.lit("")) == "", 0).when(comma & ~point, 1).when(point & ~comma, -1).when(point & comma & F.contains(t, F.lit(",")), by_shape).otherwise(0)


def iso_date(cell: Column) -> Column:
    """The cell as a date, else null: the first layout that fits; a time of day is left out."""
    t = F.trim(cell)
    days = [F.when(t.rlike(f"^{p}$"), F.try_to_date(t, layout)) for p, layout in DATE_LAYOUTS]
    times = [F.when(t.rlike(f"^{p}$"), F.try_to_timestamp(t, F.lit(layout)).cast("date")) for p, layout in TIME_LAYOUTS]
    return F.coalesce(*days, *times)


def from_serial(serial: Column, from_1904: bool = False) -> Column:
    """A workbook's day number as ISO text: a date if whole, else date and time."""
    start = F.lit("1904-01-01" if from_1904 else "1899-12-30").cast("date")
    day = F.date_add(start, F.floor(serial).cast("int"))
    seconds = F.round((serial - F.floor(serial)) * 86400).cast("int")
    clock = F.format_string("%02d:%02d:%02d", F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int"), seconds % 60)
    return F.when(seconds == 0, day.cast("string")).otherwise(F.concat_ws("T", day.cast("string"), clock))


def key_values(columns: dict[str, Column]) -> Column:
    """"name: value | name: value" of the cells that hold something."""
    return F.concat_ws(" | ", *[F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(f"{name}: "), c.cast("string"))) for name, c in columns.items()])


def is_derived_label(cell: Column) -> Column:
    """A row's label that names a total."""
    return F.lower(F.trim(F.coalesce(cell, F.lit("")))).rlike(r"^(gesamt|summe|zwischensumme|total|subtotal|grand total|sum)\b")


def is_bool(cell: Column) -> Column:
    return F.lower(F.trim(cell)).isin("true", "false", "yes", "no", "ja", "nein")


def identifier(name: Column) -> Column:
    """A column name: umlauts spelled out, lower case, other characters an underscore."""
    t = F.lower(name)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.left(F.when(t.rlike("^[0-9]"), F.concat(F.lit("col_"), t)).otherwise(t), F.lit(63))
