"""Checks of answers: whether cited sources say what stands around their markers, and runs of repetition."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARKER = re.compile(r"\[(\d+(?:\s*,\s*\d+)*)\]")
_START = re.compile(r"(?<=.)[.!?](?=[ \t\n\r])", re.DOTALL)  # a sentence starts two characters on
_END = re.compile(r"[.!?]")
_ROWS = 64  # texts that are worked on at once
LONGEST_PATTERN = 4  # code points of a pattern whose repetition counts

# fixed values: function words that don't count in overlaps, English and German
STOPWORDS = """
the a an and or but of in on at to for with by is are was were be been being have has had do does did this that
these those it its from as if then than so not no yes also such
der die das den dem des ein eine einer eines einen einem und oder aber von zu bei mit ist sind war waren sein
gewesen hat haben hatte hatten dies diese dieser dieses für auf im nicht kein keine auch
""".split()


def windows(answers: DataFrame) -> DataFrame:
    """(answer_id, marker, numbers, around) of answers (answer_id, text): each marker [n] or [n, m] in order, and its
    text from the second sentence start before it, or the only one, to the second sentence end after it."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for answer, text in zip(part.answer_id.tolist(), part.text.tolist(), strict=True):
                text = text or ""
                starts = [m.start() + 2 for m in _START.finditer(text)]
                ends = [m.end() for m in _END.finditer(text)]
                for i, m in enumerate(_MARKER.finditer(text)):
                    before = [s for s in starts if s - 2 < m.start()][-2:]
                    after = [e for e in ends if e > m.start()][:2]
                    numbers = [n for n in (int(x) for x in m[1].split(",") if len(x.strip()) < 10) if n > 0]
                    rows.append((answer, i, numbers, text[before[0] if before else 0 : after[-1] if after else len(text)]))
            yield pd.DataFrame(rows, columns=["answer_id", "marker", "numbers", "around"])

    return answers.select(F.col("answer_id").cast("long").alias("answer_id"), "text").mapInPandas(run, "answer_id long, marker int, numbers array<int>, around string")


def grams(text: Column, n: int = 3) -> Column:
    """Distinct runs of n content words: lower case, three characters or more, no function words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    words = F.filter(words, lambda w: ~w.isin(*STOPWORDS) & (F.char_length(w) >= 3))

    def runs(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, n))))

    return F.transform(F.array(words), runs)[0]  # the lambda's value is made once; else a text would be read for each of its runs


def check_citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, n, verified, reason): a verdict for each number that an answer (answer_id, text) cites.

    A marker's numbers are verified if any of its sources (answer_id, n, text; n from 1) shares a run of
    three content words with the text around it (so a run of four, too); one such marker is
    enough for a number. Else the reason is no_overlap, or out_of_range where no source has
    that number. Answers without markers have no rows; null texts are empty. A source of
    several rows, a summary and what it stands for, counts as one.
    """
    marks = windows(answers).withColumn("said", grams(F.col("around")))
    cited = marks.select("answer_id", "marker", "said", F.explode(F.array_distinct("numbers")).alias("n"))
    held = sources.select("answer_id", "n", grams(F.col("text")).alias("held"))  # runs stay in their text's row: none is dealt out by itself
    both = cited.join(held, ["answer_id", "n"], "left")
    known, shared = F.col("held").isNotNull(), F.coalesce(F.arrays_overlap("said", "held"), F.lit(False))
    met = both.groupBy("answer_id", "marker", "n").agg(F.bool_or(known).alias("known"), F.bool_or(shared).alias("shared"))
    good = F.bool_or("shared").over(Window.partitionBy("answer_id", "marker"))
    found = met.withColumn("good", F.col("known") & good).groupBy("answer_id", "n").agg(F.bool_or("good").alias("verified"), F.bool_or("known").alias("known"))
    return found.select("answer_id", F.col("n").cast("int").alias("n"), "verified", F.when(F.col("verified"), "").when(F.col("known"), "no_overlap").otherwise("out_of_range").alias("reason"))


def repeated_spans(codes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Merged spans of more than `limit` code points that repeat with a period of 1 to LONGEST_PATTERN."""
    spans = []
    for p in range(1, min(LONGEST_PATTERN, len(codes) - 1) + 1):
        same = np.concatenate(([0], (codes[p:] == codes[:-p]).astype(np.int8), [0]))
        turns = np.flatnonzero(np.diff(same))  # starts and ends of equal stretches, in turn
        starts, ends = turns[::2], turns[1::2] + p  # the stretch and the pattern before it
        long = ends - starts > limit
        spans += zip(starts[long].tolist(), ends[long].tolist(), strict=True)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of _ROWS rows at most, so that few texts are held as Python's own at once."""
    for b in batches:
        for at in range(0, b.num_rows, _ROWS):
            yield b.slice(at, _ROWS)


def without_repetition(rows: DataFrame, limit: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, text, removed): texts without their degenerate runs, and how many code points went; null stays null.

    A run is a stretch of more than `limit` code points that repeats a pattern of at most four; limits of 1 to
    3 count as 4. A limit of 0 or less removes nothing.
    """
    limit = max(limit, LONGEST_PATTERN) if limit > 0 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pieces(batches):
            texts, removed = [], []
            for text in part.column(1).to_pylist():
                spans = repeated_spans(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), limit) if text and limit > 0 else []
                cuts = [0, *(x for s in spans for x in s), len(text or "")]
                texts.append("".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if spans else text)
                removed.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["id", "text", "removed"])

    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "id long, text string, removed long")


# fixed values: quote characters that don't count in a match, and what a quote's end may have more
QUOTES, TRAILING, SHORTEST, LONGEST = "„“”\"'‚‘’", ".,;:!? ", 12, 240

_NO_QUOTES = dict.fromkeys(map(ord, QUOTES))
_COMPOSED = re.compile(rf"[^\x00-\u02ff{re.escape(QUOTES)}]")  # from there on a code point may join the one before it


def plain_form(text: str) -> tuple[str, list[int], list[int]]:
    """A text as quotes are compared (composed, lower case, runs of white space as one space, no quote
    characters), and from which to which code point of the text each of its characters comes."""
    out: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    while at < len(text):
        to, whole = at + 1, text[at]
        while to < len(text) and (ord(text[to]) > 0x2FF) and (unicodedata.combining(text[to]) or len(unicodedata.normalize("NFC", whole + text[to])) < len(unicodedata.normalize("NFC", whole)) + 1):
            whole, to = whole + text[to], to + 1
        for c in unicodedata.normalize("NFC", whole):
            if c in QUOTES:
                continue
            if c.isspace():
                if out and out[-1] == " ":
                    ends[-1] = to
                    continue
                c = " "
            small = c.lower()
            out.append(small if len(small) == 1 else c)
            starts.append(at)
            ends.append(to)
        at = to
    return "".join(out), starts, ends


def _plain_text(text: str) -> str:
    """The text of plain_form, without places; whole where nothing in it can be composed."""
    if _COMPOSED.search(text):
        return plain_form(text)[0]
    one = re.sub(r"\s+", " ", text.translate(_NO_QUOTES))
    small = one.lower()
    return small if len(small) == len(one) else "".join(c if len(c.lower()) > 1 else c.lower() for c in one)


def _span(text: str, at: int, size: int) -> tuple[int, int]:
    """From where to where in a text `size` characters of its plain form come, from the one at `at`."""
    n = 2 * (at + size) + 64
    while True:
        plain, starts, ends = plain_form(text[:n])
        if n >= len(text) or len(plain) > at + size:  # one more, as the last may go on
            return starts[at], ends[at + size - 1]
        n *= 2


def quote_spans(sources: DataFrame, quotes: DataFrame) -> DataFrame:
    """(source_id, quote, start, end): where a source (source_id, text) holds a quote (source_id, quote) for the
    first time, in code points, end exclusive, so that text[start:end] is what was quoted; null if it doesn't.

    Both are compared in plain form, the quote without spaces around it and . , ; : ! ? after it. Quotes of
    under 12 or over 240 characters are not looked for. Null texts and quotes are empty; quotes of an
    unknown source have no rows, repeated ones a row each.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[str | None, str] = (None, "")
        for part in parts:
            found = []
            for text, quote in zip(part.text.tolist(), part.quote.tolist(), strict=True):
                if text != known[0]:
                    known = (text, _plain_text(text))
                wanted = _plain_text(quote).rstrip(TRAILING).lstrip(" ")
                at = known[1].find(wanted) if SHORTEST <= len(wanted) <= LONGEST else -1
                found.append(_span(text, at, len(wanted)) if at >= 0 else (None, None))
            spans = [pd.Series([f[i] for f in found], dtype="Int32") for i in (0, 1)]
            yield pd.DataFrame({"source_id": part.source_id, "quote": part.quote, "start": spans[0], "end": spans[1]})

    asked = quotes.select(F.col("source_id").cast("long").alias("source_id"), F.coalesce("quote", F.lit("")).alias("quote"))
    both = asked.join(sources.select(F.col("source_id").cast("long").alias("source_id"), F.coalesce("text", F.lit("")).alias("text")), "source_id")
    return both.mapInPandas(run, "source_id long, quote string, start int, end int")
