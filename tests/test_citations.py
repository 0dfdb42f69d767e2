"""Citation verdicts and repetition runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import time
import unicodedata

import pyarrow as pa
import pytest

from quillspark.operators import citations
from quillspark.plans import clusters as plans

MARK = re.compile(r"\[(\d+(?:\s*,\s*\d+)*)\]")


def content(text):
    return [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if w not in citations.STOPWORDS and len(w) >= 3]


def runs(text, n):
    w = content(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def around(text, at):
    starts, i = [], at - 1
    while i > 0 and len(starts) < 2:
        if text[i] in ".!?" and i + 1 < len(text) and text[i + 1] in " \t\n\r":
            starts.append(i + 2)
        i -= 1
    ends = [i + 1 for i in range(at, len(text)) if text[i] in ".!?"][:2]
    return text[starts[-1] if starts else 0 : ends[-1] if ends else len(text)]


def brute(answers, sources):
    out = {}
    for a, text in answers:
        text = text or ""
        for m in MARK.finditer(text):
            numbers = [int(x) for x in m[1].split(",") if int(x) > 0]
            window = around(text, m.start())
            held = {n for i, n, _ in sources if i == a and n in numbers}
            good = any(runs(window, k) & runs(t, k) for i, n, t in sources if i == a and n in held for k in (4, 3))
            for n in numbers:
                before = out.get((a, n), (False, ""))
                if not before[0]:
                    out[a, n] = (True, "") if n in held and good else (False, "no_overlap" if n in held else "out_of_range")
    return out


def test_verdicts(spark):
    rng = random.Random(2)
    pool = "Der Hund läuft schnell durch den großen Wald und findet einen alten Knochen the quick brown fox jumps over it".split()
    sentence = lambda: " ".join(rng.choices(pool, k=rng.randrange(2, 9))) + rng.choice([".", "!", "?", ""])
    mark = lambda: rng.choice(["", "[1]", "[2]", "[1, 2]", "[3 ,1]", "[9]", "[0]", "[x]"])
    answers = [(i, " ".join(sentence() + mark() for _ in range(rng.randrange(1, 7)))) for i in range(200)] + [(200, None), (201, "no marker."), (202, "[1]")]
    sources = [(i, n, " ".join(sentence() for _ in range(rng.randrange(1, 4)))) for i in range(203) for n in (1, 2, 3)] + [(5, 1, None), (6, 2, "noch ein Text")]
    out = citations.check_citations(spark.createDataFrame(answers, "answer_id long, text string"), spark.createDataFrame(sources, "answer_id long, n int, text string"))
    got = {(r.answer_id, r.n): (r.verified, r.reason) for r in out.collect()}
    assert got == brute(answers, sources) and {v for v, _ in got.values()} == {True, False}


def test_registered_verdicts(spark):
    answers, sources = plans._answers(spark, "/root/testdata/sf0.001")
    got = {(r.answer_id, r.n): (r.verified, r.reason) for r in plans.citation_verdicts(spark, "/root/testdata/sf0.001").collect()}
    by = [tuple(r) for r in sources.collect()]
    want = {}
    for a, t in (tuple(r) for r in answers.collect()):
        want |= brute([(a, t)], [s for s in by if s[0] == a])
    assert got == want


def plain(text, limit):
    """Marks every code point of each maximal periodic region, one by one."""
    gone = set()
    for p in range(1, 5):
        region = 0
        for j in range(len(text) + 1):
            if j < len(text) and j >= p and text[j] == text[j - p]:
                region += 1
                continue
            if region > limit:
                gone |= set(range(j - region, j))
            region = min(j + 1, p)
    return "".join(c for i, c in enumerate(text) if i not in gone), len(gone)


@pytest.mark.parametrize("limit", [0, 3, 4, 8])
def test_repetition(spark, limit):
    rng = random.Random(limit)
    texts = ["", "a", "ab", "aaaaaaaaaaaa", "abababababab", "日本日本日本日本日本", "xaaaaaaaaabbbbbbbbby", "abcabcabcabcabd" * 3, "abcdeabcdeabcde"]
    texts += ["".join(rng.choices("ab", k=rng.randrange(60))) for _ in range(200)] + ["z" * 200_000 + "end"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(-1, None)]
    got = {r.id: (r.text, r.removed) for r in citations.without_repetition(spark.createDataFrame(rows, "id long, text string"), limit).collect()}
    assert got == {i: (None, 0) if t is None else plain(t, max(limit, 4)) if limit else (t, 0) for i, t in rows}


def test_registered_repetition(spark):
    docs = {r.doc_id: re.sub(r"[ \t\n\x0b\f\r]", "", (r.text or "").lower()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in plans.repetition_runs(spark, "/root/testdata/sf0.001").collect():
        text, removed = plain(docs[r.doc_id], 12)
        assert (r.removed, r.digest) == (removed, hashlib.sha256(text.encode()).hexdigest())


def test_quote_spans(spark):
    texts = {1: 'Er sagte: „Das  Haus\nist alt“, und ging.', 2: unicodedata.normalize("NFD", "Café crème brûlée ist gut"), 3: unicodedata.normalize("NFD", "한국어 텍스트 문장 여러 개"), 4: None, 5: "abc " * 40_000 + "the very last words"}
    cases = [
        (1, "das haus ist alt", (11, 28)), (1, "'Das Haus ist alt, und ging...'", (11, 39)), (1, "zu kurz", None), (1, "das haus ist neu", None),
        (2, "CAFÉ CRÈME BRÛLÉE", (0, 21)), (2, "crème brûlée ist", (6, 25)), (3, "한국어 텍스트 문장 여러", (0, len(unicodedata.normalize("NFD", "한국어 텍스트 문장 여러")))), (4, "something long enough", None), (5, " The very last  words!", (160_000, 160_019)), (5, "x" * 241, None), (1, None, None),
    ]
    out = citations.quote_spans(spark.createDataFrame(list(texts.items()), "source_id long, text string"), spark.createDataFrame([c[:2] for c in cases] + [(99, "of an unknown source")], "source_id long, quote string"))
    got = {(r.source_id, r.quote): None if r.start is None else (r.start, r.end) for r in out.collect()}
    assert got == {(i, q or ""): span for i, q, span in cases}


def test_registered_quotes(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = plans.quoted_places(spark, "/root/testdata/sf0.001").collect()
    squeeze = lambda t: " ".join("".join(c for c in t.lower() if c not in citations.QUOTES).split()).rstrip(citations.TRAILING)
    assert len(found) == len(docs)
    for r in found:
        wanted = squeeze(docs[r.source_id][20:100])
        if len(wanted) < 12 or squeeze(docs[r.source_id][20:100].upper()) != wanted:  # ß has no capital of its own
            assert r.start is None
        else:
            assert r.start <= 21 and squeeze(docs[r.source_id][r.start : r.end]) == wanted


def test_runs_of_a_long_text_are_made_in_one_reading(spark):
    words = " ".join(f"word{i}" for i in range(20_000))
    answers = spark.createDataFrame([(1, "word17 word18 word19 [1]. word5 word7 word9 [2].")], "answer_id long, text string")
    sources = spark.createDataFrame([(1, 1, words), (1, 2, words)], "answer_id long, n int, text string")
    began = time.monotonic()
    out = {r.n: r.reason for r in citations.check_citations(answers, sources).collect()}
    assert out == {1: "", 2: "no_overlap"}
    assert time.monotonic() - began < 30


def test_plain_text_and_spans_are_those_of_the_whole_plain_form():
    rng = random.Random(8)
    for i in range(2000):
        text = "".join(rng.choice("aBß İÄé\"'  \n\t\xa0„”ſ.x" + "́̈Σ" * (i % 2)) for _ in range(rng.randrange(1, 300)))
        plain, starts, ends = citations.plain_form(text)
        assert citations._plain_text(text) == plain
        if plain:
            at = rng.randrange(len(plain))
            size = rng.randrange(1, len(plain) - at + 1)
            assert citations._span(text, at, size) == (starts[at], ends[at + size - 1])


def test_repetition_is_worked_on_by_few_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(["x"] * 150)], names=["id", "text"])
    assert [b.num_rows for b in citations._pieces(iter([batch]))] == [64, 64, 22]
