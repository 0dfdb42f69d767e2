"""Fuzzy line de-duplication with DataFrame functions only.

Lines are normalised; equal ones form a class. Each class gets a SimHash of its words.
Classes whose fingerprints share enough bit blocks to differ in max_bits bits at most are
compared by edit similarity in characters; verified links make groups. One occurrence of each
group stays.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch, stored
from quillspark.llm.fingerprint_pairs import block_masks, blocks_for, list_components, partnered, posting_lists

_LONG_LIST = 200  # fingerprints of a posting list, beyond which it is split by finer keys
_SMALL = 500_000  # ids that may be broadcast: 4 MB
_LONG_LINE, _CHUNK = 1000, 64  # characters beyond which a bound by runs of so many words is tried first
_BITS = 60  # of a fingerprint: lanes of 15 or 30 bits fill a long but for its sign
_LANE_WORDS = (1 << 14) - 1  # words of a line that a counter of 15 bits holds, with what lifts it


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, rid, pos, norm, octets, h1, h2): the lines of each text that hold a letter or digit."""
    text = F.col(text_col).cast("string")
    # the whole text is normalised at once, and before its lines are dealt into rows: no later filter repeats it
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rid"), F.posexplode(F.split(plain, "\n")).alias("pos", "line"))
    rows = rows.select("id", "rid", "pos", F.trim("line").alias("norm")).where("norm <> ''")
    return rows.select("*", F.octet_length("norm").alias("octets"), F.xxhash64("norm").alias("h1"), F.xxhash64(F.lit(1), "norm").alias("h2"))


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def _counted(lines: DataFrame, width: int) -> DataFrame:
    """(h1, h2, keep, keep_rid, n, fp): word hashes counted bit by bit, _BITS / width counters of `width` bits
    in a long. Each line is counted by itself (key `row`), so that a line of any number of occurrences is many
    groups before they meet; a bit is set if it is in over half of the words."""
    hashes = F.sort_array(F.transform(F.split("norm", " "), lambda w: F.xxhash64(w)))
    words = lines.select("id", "rid", "h1", "h2", hashes.alias("s"), F.monotonically_increasing_id().alias("row"))
    # the row's number stands beside the lambda: Spark moves no filter of explode's below it
    words = words.select("id", "rid", "h1", "h2", "row", "s", F.posexplode("s").alias("i", "h"))
    # of sorted hashes each word's first two: what repeats weighs twice, and function words don't outvote the rest
    words = words.where((F.col("i") < 2) | (F.col("h") != F.get("s", F.col("i") - 2)))
    ones = sum(1 << at for at in range(0, _BITS, width))
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(ones))).alias(f"s{i}") for i in range(width)]
    null_rid = F.min(F.when(F.col("id").isNull(), F.col("rid")))
    counted = words.groupBy("h1", "h2", "row").agg(F.min("id").alias("keep"), null_rid.alias("keep_rid"), F.count("*").alias("c"), *sums)
    # what lifts a counter of over half of the words to its lane's highest bit, in all lanes at once
    half = 1 << (width - 1)
    counted = counted.withColumn("lift", (F.lit(half - 1) - F.shiftright("c", 1)) * ones)
    bits = [F.shiftleft(F.shiftrightunsigned((F.col(f"s{i}") + F.col("lift")).bitwiseAND(F.lit(ones * half)), width - 1), i) for i in range(width)]
    return counted.select("h1", "h2", "keep", "keep_rid", F.lit(1).cast("long").alias("n"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fp"))


def line_classes(lines: DataFrame) -> DataFrame:
    """(h1, h2, fp, n, keep, keep_rid): a row per normalised line with its fingerprint, occurrences and
    least id, and the least row key of those without an id. A line of so many bytes that its words could
    overflow a counter is counted with wider ones; the bits are the same."""
    most = 2 * _LANE_WORDS - 1  # bytes: n words take 2n - 1 or more
    counted = _counted(lines.where(F.col("octets") <= most), 15).union(_counted(lines.where(F.col("octets") > most), 30))
    return counted.groupBy("h1", "h2").agg(F.max("fp").alias("fp"), F.sum("n").alias("n"), F.min("keep").alias("keep"), F.min("keep_rid").alias("keep_rid"))


def apart_at_most(a: Column, b: Column) -> Column:
    """No less than the edit distance of two lines: the sum over their runs of _CHUNK words."""
    chunks = F.greatest(F.size(F.split(a, " ")), F.size(F.split(b, " "))) / _CHUNK

    def cut(line: Column) -> Column:
        whole = F.array(F.split(line, " "))  # the lambda's value is made once
        numbers = F.sequence(F.lit(0), F.ceil(chunks).cast("int") - 1)
        return F.flatten(F.transform(whole, lambda w: F.transform(numbers, lambda i: F.array_join(F.slice(w, i * _CHUNK + 1, F.lit(_CHUNK)), " "))))

    each = F.zip_with(cut(a), cut(b), lambda x, y: F.levenshtein(x, y) + ((x == "") != (y == "")).cast("int"))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def unlike_parts(a: Column, b: Column) -> Column:
    """(a, b): two lines without the words that they share at their start and at their end, each word
    with a space after it. Their edit distance is that of the lines."""

    def alike(x: Column, y: Column) -> Column:
        """How many words of x and y are equal before the first that isn't."""
        first = F.array_position(F.zip_with(x, y, lambda i, j: i.eqNullSafe(j)), False).cast("int")
        return F.when(first == 0, F.size(x)).otherwise(first - 1)

    def middle(x: Column, start: Column, end: Column) -> Column:
        return F.array_join(F.transform(F.slice(x, start + 1, F.size(x) - start - end), lambda w: F.concat(w, F.lit(" "))), "")

    def cut(w: Column) -> Column:
        x, y = w["x"], w["y"]
        start = alike(x, y)
        end = F.least(alike(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - start)
        return _let(F.struct(start.alias("start"), end.alias("end")), lambda n: F.struct(middle(x, n["start"], n["end"]).alias("a"), middle(y, n["start"], n["end"]).alias("b")))

    return _let(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y")), cut)


def apart_by_words(a: Column, b: Column) -> Column:
    """No less than the edit distance: the sum over words at the same place; one without a partner goes with its space."""
    apart = lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(F.coalesce(F.levenshtein(x, y), F.char_length(F.coalesce(x, y)) + 1))
    return F.aggregate(F.zip_with(F.split(a, " "), F.split(b, " "), apart), F.lit(0), lambda total, x: total + x)


def similar(a: Column, b: Column, least: float) -> Column:
    """Edit similarity, 1 - distance / longer length in characters, of least or more."""
    # a little slack for products like 0.2 * 5 that fall short of a whole number
    most = F.floor(F.greatest(F.char_length(a), F.char_length(b)) * (1 - least) + 1e-9).cast("int")
    near = F.abs(F.char_length(a) - F.char_length(b)) <= most

    def close(p: Column) -> Column:
        longer = F.greatest(F.char_length(p["a"]), F.char_length(p["b"]))
        within = lambda part: F.call_function("levenshtein", p["a"], p["b"], F.floor(most / part).cast("int")) >= 0
        # what a bound or a narrow band shows needs no whole comparison; the answer is the same
        quick = F.when((longer <= most) | (apart_by_words(p["a"], p["b"]) <= most), True).when(longer > _LONG_LINE, apart_at_most(p["a"], p["b"]) <= most).otherwise(within(16))
        return F.when(quick, True).when((longer <= _LONG_LINE) & within(4), True).otherwise(within(1))

    return F.when(near, _let(unlike_parts(a, b), close)).otherwise(False)


def linked_classes(lines: DataFrame, classes: DataFrame, max_bits: int, least: float) -> DataFrame:
    """(h1, component) of the classes that have a verified link.

    Most classes have no near fingerprint at all; those go first (partnered). Fingerprints that differ
    in at most max_bits (0 to 3) bits share all but max_bits of their
    blocks, and every choice of so many makes a key; more rows take more blocks (blocks_for).
    Lists of more than _LONG_LIST lines are split exactly by all choices of 8 - max_bits of
    eight blocks.
    """
    with Scratch(lines.sparkSession) as scratch:
        rows = partnered(classes.select(F.col("h1").alias("node"), "fp"), max_bits, _BITS)
        blocks = blocks_for(rows.count(), max_bits, _BITS)
        coarse, fine = block_masks(blocks, blocks - max_bits, _BITS), block_masks(8, 8 - max_bits, _BITS)
        lists = posting_lists(rows, coarse, fine, _LONG_LIST)

        def near(a: Column, b: Column) -> Column:
            return F.bit_count(a.bitwiseXOR(b)) <= max_bits

        def verify(pairs: DataFrame) -> DataFrame:
            wanted = scratch.stored(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct())
            few = wanted.count() <= _SMALL
            texts = lines.select("h1", "norm").join(F.broadcast(wanted) if few else wanted, "h1").groupBy("h1").agg(F.min("norm").alias("t"))
            texts = scratch.stored(texts)
            both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
            return scratch.stored(both.where(similar(F.col("ta"), F.col("tb"), least)).select("a", "b"))

        return list_components(lists, near, verify).withColumnRenamed("node", "h1")


def duplicate_groups(lines: DataFrame, max_bits: int, least: float) -> DataFrame:
    """(h1, h2, r1, r2, keep, keep_rid): the classes of groups with more than one occurrence, with the
    group's number, the least id that has an occurrence, and the least row key of those without an id."""
    with Scratch(lines.sparkSession) as scratch:
        classes = scratch.stored(line_classes(lines))
        linked = linked_classes(lines, classes, max_bits, least)
        members = classes.join(linked, "h1")
        kept = members.groupBy("component").agg(F.min("keep").alias("k"), F.min("keep_rid").alias("kr"))
        fuzzy = members.join(kept, "component").select("h1", "h2", F.col("component").alias("r1"), F.lit(0).cast("long").alias("r2"), F.col("k").alias("keep"), F.col("kr").alias("keep_rid"))
        exact = classes.where("n > 1").join(linked, "h1", "left_anti").select("h1", "h2", F.col("h1").alias("r1"), F.col("h2").alias("r2"), "keep", "keep_rid")
        return stored(fuzzy.union(exact))


def removed_lines(docs: DataFrame, id_col: str, text_col: str, max_bits: int, least: float) -> DataFrame:
    """(id, rid, gone): positions of the lines to remove from each text that loses some, in order."""
    with Scratch(docs.sparkSession) as scratch:
        lines = scratch.stored(line_rows(docs, id_col, text_col))
        groups = duplicate_groups(lines, max_bits, least)
        own = F.col("id").eqNullSafe(F.col("keep")) & (F.col("id").isNotNull() | (F.col("rid") == F.col("keep_rid")))
        hits = lines.select("id", "rid", "pos", "h1", "h2").join(groups, ["h1", "h2"]).select("id", "rid", "pos", "r1", "r2", own.alias("own"))
        hits = scratch.stored(hits)
        mine = hits.where("own")
        first = mine.groupBy("r1", "r2").agg(F.min(F.struct("rid", "pos")).alias("first"))  # rows that repeat id and text are alike
        later = mine.join(first, ["r1", "r2"]).where(F.struct("rid", "pos") > F.col("first")).select("id", "rid", "pos")
        gone = hits.where("NOT own").select("id", "rid", "pos").union(later)
        return stored(gone.groupBy("id", "rid").agg(F.array_sort(F.collect_set("pos")).alias("gone")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, least: float = 0.8) -> DataFrame:
    """docs with duplicate lines removed from text_col, and n_lines and n_removed (long) added.

    Lines are compared lower-cased, with each run of other characters than letters and digits
    as one space; lines without any are never removed. Two lines are linked if their
    fingerprints differ in max_bits bits or fewer and their edit similarity in characters is
    `least` or more, at any length. Of a group, the occurrence in the
    smallest id stays, and there the first line of the text with the smallest hash. A null id
    comes after all others, and of texts without an id the one with the smallest hash comes first. Rows that repeat id and text are one document: all get its result.
    Null text stays null with 0 lines; empty text stays empty; a text may become empty. Columns
    named n_lines or n_removed are replaced. An empty table stays empty.
    """
    gone = removed_lines(docs, id_col, text_col, max_bits, least)
    rows = docs.withColumn("__rid", row_key(id_col, text_col))
    # the small side is hashed: whole texts are not sorted
    gone = gone.select(F.col("id").alias("__id"), F.col("rid").alias("__gone_rid"), F.col("gone").alias("__gone")).hint("shuffle_hash")
    rows = rows.join(gone, (F.col("__rid") == F.col("__gone_rid")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    lines = F.split(F.col(text_col).cast("string"), "\n")

    def without_gone(x: Column) -> Column:
        """The runs of lines x between removed ones."""
        before = lambda j: F.when(j > 0, F.element_at("__gone", F.greatest(j, F.lit(1)))).otherwise(F.lit(-1))
        after = lambda j: F.when(j < F.size("__gone"), F.element_at("__gone", F.least(j + 1, F.size("__gone")))).otherwise(F.size(x))
        runs = F.transform(F.sequence(F.lit(0), F.size("__gone")), lambda j: F.slice(x, before(j) + 2, after(j) - before(j) - 1))
        return F.array_join(F.flatten(runs), "\n")

    kept = F.when(F.col("__gone").isNull(), F.col(text_col).cast("string")).otherwise(_let(lines, without_gone))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = rows.withColumns({"__n": n_lines, "__m": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "__kept": kept})
    out = out.withColumn("__m", F.when(F.col("__gone").isNull(), 0).otherwise(F.col("__m")).cast("long"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*[F.col("__kept").alias(c) if c == text_col else F.col(c) for c in names], F.col("__n").alias("n_lines"), F.col("__m").alias("n_removed"))
