"""Regions of sheets, their header rows and kinds, from a table of filled cells.

cells: (sheet, row, col, raw, kind, styled), a row per filled cell, counted from 0; kind is text,
number, date or bool. merges: (sheet, from_row, from_col, to_row, to_col). Rows and columns
are found by gaps and islands over all cells; only a region's few rows at its top, a line per
column, meet in a group, where they are scored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.cells import iso_date, number

# fixed values: weights and limits of the rules below
TEXT, DISTINCT, COVERAGE, SIGNAL, STYLE = 0.35, 0.15, 0.25, 0.15, 0.10
CONTINUES, FLAT, OVERLAP, ALIGNED, GUTTER_WIDTH = 0.35, 0.15, 0.8, 0.9, 2
HEADER_LEAST, SCANNED, LONG_VALUE, TITLE_MERGE, GROUP_MERGE, SPACER = 0.45, 20, 80, 3, 2, 0.05
PAIR_RATIO, PAIR_FILL, FORM_MERGES, CONTRAST, TABLE_ROWS, TABLE_FILL, SHORT, SHORT_SHARE = 0.4, 2, 5, 0.15, 3, 0.5, 40, 0.8

_BIN = 64  # rows of a bin in which a row looks for the next filled cells
_REGION = "sheet string, top int, left int, bottom int, right int, open_ended boolean"


def value_like(raw: Column, kind: Column) -> Column:
    """Whether a cell reads as a value and not as a label."""
    return (kind != "text") | number(raw).isNotNull() | number(raw, True).isNotNull() | iso_date(raw).isNotNull() | (F.char_length(raw) > LONG_VALUE)


def sheet_cells(cells: DataFrame) -> DataFrame:
    """Filled cells with label (text that is no value) and key (what makes cells distinct)."""
    rows = cells.where("sheet IS NOT NULL AND row >= 0 AND col >= 0 AND trim(raw) <> ''")
    label = ~value_like(F.col("raw"), F.col("kind"))
    return rows.select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "raw", "kind", F.coalesce("styled", F.lit(False)).alias("styled"), label.alias("label"), F.lower(F.trim("raw")).alias("key"))


def _grid(cells: DataFrame, merges: DataFrame | None) -> DataFrame:
    """(sheet, row, col) that count as filled: cells, and all of a merged range whose first cell is filled."""
    grid = cells.select("sheet", "row", "col")
    if merges is None:
        return grid
    first = merges.join(grid.select("sheet", F.col("row").alias("from_row"), F.col("col").alias("from_col")), ["sheet", "from_row", "from_col"], "left_semi")
    spread = first.select("sheet", F.explode(F.sequence("from_row", "to_row")).alias("row"), "from_col", "to_col").select("sheet", "row", F.explode(F.sequence("from_col", "to_col")).alias("col"))
    used = grid.groupBy("sheet").agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))
    inside = spread.join(used, "sheet").where("row <= last_row AND col <= last_col").select("sheet", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))
    return grid.union(inside).distinct()


def _islands(rows: DataFrame, of: list[str], n: str, name: str) -> DataFrame:
    """rows (of, n), distinct, with the number of the run of consecutive n that each is in."""
    w = Window.partitionBy(*of).orderBy(n)
    starts = F.when(F.col(n) - F.lag(n).over(w) == 1, 0).otherwise(1)
    return rows.withColumn("starts", starts).withColumn(name, F.sum("starts").over(w)).drop("starts")


def blocks(grid: DataFrame) -> DataFrame:
    """(sheet, band, first, last, left, right, top, bottom): the blocks of filled columns of each band of
    filled rows (first to last), cut to the rows they fill. Blocks two columns wide or more with one
    blank column between them are one if they fill the same rows, nine of ten at least."""
    rows = _islands(grid.select("sheet", "row").distinct(), ["sheet"], "row", "band")
    cells = grid.join(rows, ["sheet", "row"])
    columns = _islands(cells.select("sheet", "band", "col").distinct(), ["sheet", "band"], "col", "run")
    runs = columns.groupBy("sheet", "band", "run").agg(F.min("col").alias("left"), F.max("col").alias("right"))
    filled = cells.join(columns, ["sheet", "band", "col"]).groupBy("sheet", "band", "run").agg(F.collect_set("row").alias("rows"))
    one = F.struct("left", "right", "rows")
    bands = runs.join(filled, ["sheet", "band", "run"]).groupBy("sheet", "band").agg(F.array_sort(F.collect_list(one)).alias("runs"))

    def put(done: Column, new: Column) -> Column:
        last = F.element_at(done, -1)
        both, most = F.size(F.array_intersect(last["rows"], new["rows"])), F.greatest(F.size(last["rows"]), F.size(new["rows"]))
        wide = lambda x: x["right"] - x["left"] + 1 >= GUTTER_WIDTH
        joins = (new["left"] - last["right"] == 2) & wide(last) & wide(new) & (both >= ALIGNED * most)
        joined = F.struct(last["left"].alias("left"), new["right"].alias("right"), F.array_union(last["rows"], new["rows"]).alias("rows"))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(new)))

    merged = F.aggregate(F.slice("runs", 2, F.size("runs")), F.slice("runs", 1, 1), put)
    out = bands.select("sheet", "band", F.explode(merged).alias("x"))
    edges = rows.groupBy("sheet", "band").agg(F.min("row").alias("first"), F.max("row").alias("last"))
    return out.join(edges, ["sheet", "band"]).select("sheet", "band", "first", "last", "x.left", "x.right", F.array_min("x.rows").alias("top"), F.array_max("x.rows").alias("bottom"))


def row_views(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """For each of rows (sheet, row) and each column with a cell there or below: col, the cell's label, key,
    styled and kind (null where there is none), and next_row and next_kind of the first cell below.

    A cell is the first below all rows from the cell above it on; both sides meet in bins of rows.
    """
    above = F.lag("row").over(Window.partitionBy("sheet", "col").orderBy("row"))
    spans = cells.withColumn("above", F.coalesce(above, F.lit(0))).where("row > 0")
    spans = spans.select("sheet", "col", F.col("row").alias("next_row"), F.col("kind").alias("next_kind"), "above", F.explode(F.sequence(F.floor(F.col("above") / _BIN), F.floor((F.col("row") - 1) / _BIN))).alias("bin"))
    wanted = rows.select("sheet", "row").distinct()
    below = wanted.withColumn("bin", F.floor(F.col("row") / _BIN)).join(spans, ["sheet", "bin"]).where("above <= row AND row < next_row").select("sheet", "row", "col", "next_row", "next_kind")
    own = cells.join(wanted, ["sheet", "row"], "left_semi").select("sheet", "row", "col", "label", "key", "styled", "kind")
    return own.join(below, ["sheet", "row", "col"], "full")


def score(view: pd.DataFrame, left: int, right: int, bottom: int) -> float:
    """How much a row (its view) looks like the header of a region: shares of labels, of distinct cells, of
    columns in use below that it fills, of labels over numbers or dates, and of styled cells."""
    view = view[(view.col >= left) & (view.col <= right)]
    own = view[view.key.notna()]
    if own.empty or (len(own) < 2 and right > left):
        return 0.0
    near = view.next_row <= min(bottom, view.row.iloc[0] + 5)
    signal = (own.kind == "text") & (own.next_row <= bottom) & own.next_kind.isin(["number", "date"])
    coverage = (near & view.key.notna()).sum() / near.sum() if near.any() else 0.0
    n = len(own)
    return float(TEXT * own.label.astype(bool).sum() / n + DISTINCT * own.key.nunique() / n + COVERAGE * coverage + SIGNAL * signal.sum() / n + STYLE * own.styled.astype(bool).sum() / n)


def _chained(part: pd.DataFrame) -> pd.DataFrame:
    """The regions of one sheet from its blocks, each with the views of its first two rows: a block goes on
    with the region above that shares most of its columns, if one blank row lies between and its
    first row is no header."""
    views = {int(r): v for r, v in part[part.row.notna()].groupby("row")}
    found = part[part.band.notna()].sort_values(["band", "left"])
    found = found.astype({c: int for c in ("band", "first", "last", "left", "right", "top", "bottom")})
    last_row, none = part.last_row.iloc[0], part.iloc[:0]
    out: list[dict[str, int]] = []

    def scored(row: int, of: dict[str, int]) -> float:
        return score(views.get(row, none), of["left"], of["right"], of["bottom"])

    def continues(above: dict[str, int], new: dict[str, int]) -> bool:
        top = scored(new["top"], new)
        if top < CONTINUES:
            return True
        if new["right"] > new["left"] and new["bottom"] > new["top"] and above["bottom"] > above["top"] and scored(above["top"], above) - scored(above["top"] + 1, above) >= FLAT:
            return top - scored(new["top"] + 1, new) < FLAT
        return False

    before: list[dict[str, int]] = []
    end = -2
    for _, band in found.groupby("band"):
        mine = []
        for b in band.itertuples():
            new = {"top": b.top, "left": b.left, "bottom": b.bottom, "right": b.right}
            shared = lambda r: min(r["right"], new["right"]) - max(r["left"], new["left"]) + 1  # noqa: B023, E731
            fits = [r for r in before if b.first == end + 2 and shared(r) > 0 and shared(r) >= OVERLAP * (min(r["right"] - r["left"], b.right - b.left) + 1)]
            best = max(fits, key=shared, default=None)  # the first among equals
            if best is not None and continues(best, new):
                best |= {"bottom": b.bottom, "left": min(best["left"], b.left), "right": max(best["right"], b.right)}
                mine.append(best)
            else:
                out.append(new)
                mine.append(new)
        before, end = mine, int(band["last"].iloc[0])
    rows = [{"sheet": part.sheet.iloc[0], **{k: int(v) for k, v in r.items()}, "open_ended": bool(r["bottom"] == last_row)} for r in out]
    return pd.DataFrame(rows, columns=["sheet", "top", "left", "bottom", "right", "open_ended"])


def regions(cells: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(sheet, top, left, bottom, right, open_ended): the rectangles of cells that belong together.

    open_ended regions reach the sheet's last row. Empty cells and cells without a sheet or
    place have no part; an empty table has no regions.
    """
    cells = sheet_cells(cells)
    grid = _grid(cells, merges)
    found = blocks(grid)
    tops = found.select("sheet", F.explode(F.array("top", F.col("top") + 1)).alias("row"))
    views = row_views(cells, tops)
    ends = grid.groupBy("sheet").agg(F.max("row").alias("last_row"))
    lines = found.join(ends, "sheet").unionByName(views, allowMissingColumns=True)
    last = F.max("last_row").over(Window.partitionBy("sheet"))
    lines = lines.withColumn("last_row", last)
    return lines.groupBy("sheet").applyInPandas(_chained, _REGION)


def in_regions(cells: DataFrame, found: DataFrame) -> DataFrame:
    """cells with the columns of the region that each is in."""
    return cells.join(found, "sheet").where("row BETWEEN top AND bottom AND col BETWEEN left AND right")


_HEADER = "sheet string, top int, left int, header_rows array<int>, index_row int, data_start int, confidence double"


def _header(most_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The header of one region from the views of its first rows (n filled cells, title, anchors a wide merge)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        r = part.iloc[0]
        views = {int(row): v for row, v in part.groupby("row")}
        info = {row: v.iloc[0] for row, v in views.items()}
        rows = [row for row in sorted(views) if info[row].n > 0 and not info[row].title][:SCANNED]
        scores = {row: score(views[row], r.left, r.right, r.bottom) for row in rows}
        anchor = max(rows, key=lambda x: (scores[x], -x), default=-1)
        if anchor < 0 or scores[anchor] < HEADER_LEAST:
            return pd.DataFrame(columns=["sheet", "top", "left", "header_rows", "index_row", "data_start", "confidence"])
        block, index = [anchor], -1
        for row in range(anchor - 1, int(r.top) - 1, -1):
            if len(block) >= most_rows or row not in views or not info[row].n:
                break
            own = views[row][views[row].key.notna() & views[row].col.between(r.left, r.right)].sort_values("col")
            if len(own) >= 2 and own.key.tolist() == [str(i + 1) for i in range(len(own))]:
                if index == -1 and row == block[0] - 1:
                    index = row
                    continue
                break
            if not own.label.astype(bool).all() or (len(own) <= 2 and not info[row].group):
                break
            block.insert(0, row)
        return pd.DataFrame([{"sheet": r.sheet, "top": r.top, "left": r.left, "header_rows": block, "index_row": index, "data_start": anchor + 1, "confidence": round(scores[anchor], 6)}])

    return run


def headers(cells: DataFrame, found: DataFrame, merges: DataFrame | None = None, most_rows: int = 3) -> DataFrame:
    """(sheet, top, left, header_rows, index_row, data_start, confidence) of the regions that have a header.

    The row of highest score among the first 20 that aren't titles, at least 0.45, the first
    among equals; up to most_rows - 1 rows of labels above it belong to it, and a row that counts
    1, 2, 3... directly above is the index row (else -1). Data begin below.
    """
    cells = sheet_cells(cells)
    held = in_regions(cells, found)
    region = ["sheet", "top", "left"]
    counts = held.groupBy(*region, "bottom", "right", "row").agg(F.count("*").alias("n"))
    widths = counts.groupBy(*region, "n").agg(F.count("*").alias("rows")).groupBy(*region).agg(F.max(F.struct("rows", "n"))["n"].alias("modal"))
    counts = counts.join(widths, region)
    if merges is not None:
        wide = merges.join(cells.select("sheet", F.col("row").alias("from_row"), F.col("col").alias("from_col")), ["sheet", "from_row", "from_col"], "left_semi")
        wide = wide.select("sheet", F.col("from_row").alias("row"), "from_col", (F.col("to_col") - F.col("from_col") + 1).alias("width"), (F.col("from_row") == F.col("to_row")).alias("flat"))
        met = counts.join(wide, ["sheet", "row"]).where("from_col BETWEEN left AND right").groupBy(*region, "row").agg(F.max(F.when(F.col("flat"), F.col("width"))).alias("flat_width"), F.max("width").alias("width"))
        counts = counts.join(met, [*region, "row"], "left")
    else:
        counts = counts.withColumns({"flat_width": F.lit(None).cast("int"), "width": F.lit(None).cast("int")})
    title = ((F.col("n") <= 2) & (F.col("modal") >= 4)) | ((F.col("n") == 1) & (F.coalesce("flat_width", F.lit(0)) >= TITLE_MERGE))
    counts = counts.withColumn("title", title).withColumn("group", F.coalesce("width", F.lit(0)) >= GROUP_MERGE)
    before = F.sum(F.when(F.col("title"), 0).otherwise(1)).over(Window.partitionBy(*region).orderBy("row"))
    first = counts.withColumn("scanned", before).where(F.col("scanned") <= SCANNED)
    views = first.join(row_views(cells, first), ["sheet", "row"]).select(*region, "bottom", "right", "row", "n", "title", "group", "col", "label", "key", "styled", "kind", "next_row", "next_kind")
    return views.groupBy(*region).applyInPandas(_header(most_rows), _HEADER)


def header_names(cells: DataFrame, found: DataFrame, heads: DataFrame) -> DataFrame:
    """(sheet, top, left, col, name, fill): the columns of each region with a header that hold a header text or
    fill a twentieth of the data rows; name joins the distinct header texts by " / ", or is "Spalte n"."""
    region = ["sheet", "top", "left"]
    held = in_regions(sheet_cells(cells), found).join(heads.drop("index_row", "confidence"), region)
    text = F.when(F.array_contains("header_rows", F.col("row")), F.struct("row", F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("text")))
    of = held.groupBy(*region, "bottom", "data_start", "col").agg(F.array_sort(F.collect_list(text)).alias("texts"), F.count_if(F.col("row") >= F.col("data_start")).alias("n"))
    rows = F.col("bottom") - F.col("data_start") + 1
    fill = F.when(rows > 0, F.try_divide(F.col("n"), rows)).otherwise(0.0)

    def once(done: Column, x: Column) -> Column:
        return F.when(F.exists(done, lambda d: F.lower(d) == F.lower(x["text"])), done).otherwise(F.concat(done, F.array(x["text"])))

    names = F.aggregate("texts", F.array().cast("array<string>"), once)
    kept = of.withColumn("fill", fill).where((F.size("texts") > 0) | (F.col("fill") >= SPACER))
    name = F.when(F.size("texts") > 0, F.array_join(names, " / ")).otherwise(F.concat(F.lit("Spalte "), (F.col("col") + 1).cast("string")))
    return kept.select(*region, "col", name.alias("name"), F.round("fill", 6).alias("fill"))


def kinds(cells: DataFrame, found: DataFrame, heads: DataFrame, names: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(sheet, top, left, kind): table, form or prose of each region.

    A form pairs a text with a cell beside it in rows of two cells, in two of five cells, and has five
    merged ranges, or one and a header that differs little from its data. A table has a
    header, three data rows (one if open-ended) and columns half filled; one column needs short cells
    that aren't sentences. What pairs or merges like a form without being a table is a form.
    found, heads and names (of header_names) are read several times: give stored tables.
    """
    region = ["sheet", "top", "left"]
    clean = sheet_cells(cells)
    held = in_regions(clean, found)
    right = F.lead("col").over(Window.partitionBy(*region, "row").orderBy("col"))
    filled = F.count("*").over(Window.partitionBy(*region, "row"))
    sides = held.withColumn("to", right).withColumn("n", filled)
    direct = F.col("to") == F.col("col") + 1
    if merges is not None:  # a merged text may be followed by the cells that it covers
        span = merges.select("sheet", F.col("from_row").alias("row"), F.col("from_col").alias("col"), F.col("to_col").alias("covered"))
        sides = sides.join(span.groupBy("sheet", "row", "col").agg(F.max("covered").alias("covered")), ["sheet", "row", "col"], "left")
        direct = F.col("to") <= F.coalesce("covered", F.col("col")) + 1
    pair = (F.col("kind") == "text") & (F.col("n") <= PAIR_FILL) & F.coalesce(direct, F.lit(False))
    facts = [sides.groupBy(*region).agg((F.count_if(pair) / F.count("*")).alias("pairs")), heads.select(*region, "data_start", "confidence")]
    if merges is not None:
        met = found.join(merges, "sheet").where("from_row <= bottom AND to_row >= top AND from_col <= right AND to_col >= left")
        facts.append(met.groupBy(*region).agg(F.count("*").alias("merges")))
    # how the first five data rows score, for the header's contrast
    after = heads.join(found, region).select(*region, "bottom", "right", F.explode(F.sequence("data_start", F.least(F.col("bottom"), F.col("data_start") + 4))).alias("row"), "data_start").where("data_start <= bottom")
    views = after.join(row_views(clean, after), ["sheet", "row"], "left")
    facts.append(views.groupBy(*region).applyInPandas(_median_score, "sheet string, top int, left int, median double"))
    names = names.groupBy(*region).agg(F.avg(F.when(F.col("fill") >= SPACER, F.col("fill"))).alias("mean_fill"), F.count("*").alias("columns"), F.min("col").alias("only"))
    facts.append(names)
    single = held.join(names.where("columns = 1").select(*region, "only"), region).join(heads.select(*region, "data_start"), region).where("row >= data_start AND col = only")
    text = F.trim("raw")
    facts.append(single.groupBy(*region).agg((~F.bool_or(F.endswith(text, F.lit("."))) & (F.count_if(F.char_length(text) <= SHORT) >= SHORT_SHARE * F.count("*"))).alias("short")))
    # one row of each kind of fact and region: they meet by a union, which plans better than a row of joins
    every = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [found.select(*region, "bottom", "open_ended"), *facts])
    named = ("bottom", "open_ended", "pairs", "data_start", "confidence", "median", "mean_fill", "columns", "short")
    n_merges = F.coalesce(F.max("merges"), F.lit(0)) if merges is not None else F.lit(0)
    out = every.groupBy(*region).agg(*(F.max(c).alias(c) for c in named), n_merges.alias("merges"))
    has_header = F.col("data_start").isNotNull() & F.col("columns").isNotNull()
    low = has_header & (F.col("merges") >= 1) & (F.coalesce(F.col("confidence") - F.col("median"), F.lit(1.0)) < CONTRAST)
    rows = F.col("bottom") - F.col("data_start") + 1
    enough = (rows >= TABLE_ROWS) | (F.col("open_ended") & (rows >= 1))
    table = has_header & enough & (F.coalesce("mean_fill", F.lit(0.0)) >= TABLE_FILL) & ((F.col("columns") > 1) | F.coalesce("short", F.lit(False)))
    kind = F.when((F.col("pairs") >= PAIR_RATIO) & ((F.col("merges") >= FORM_MERGES) | low), "form").when(table, "table").when((F.col("pairs") >= PAIR_RATIO) | (F.col("merges") >= FORM_MERGES), "form").otherwise("prose")
    return out.select(*region, kind.alias("kind"))


def _median_score(part: pd.DataFrame) -> pd.DataFrame:
    r = part.iloc[0]
    found = sorted(score(v[v.col.notna()], r.left, r.right, r.bottom) for _, v in part.groupby("row"))
    return pd.DataFrame([{"sheet": r.sheet, "top": r.top, "left": r.left, "median": found[len(found) // 2]}])
