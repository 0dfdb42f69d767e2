"""What a question asks for, as columns: literals, phrases, windows of time, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMAIL = r"\b[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
# fixed values: beginnings and parts of questions about a person or thing's role
ENTITY_PREFIXES = ("wer ", "wem ", "wen ", "wessen ", "who ", "whom ", "whose ")
ENTITY_PARTS = ("welche rolle", "welche funktion", "welche aufgabe", "welche position", "welche stellung", "in welcher rolle", "what role", "what function", "what position")
# fixed values: question words that begin no name
QUESTION_WORDS = ("Welche", "Welcher", "Welches", "Welchem", "Welchen", "Wer", "Wen", "Wem", "Wessen", "Was", "Wo", "Wohin", "Woher", "Wann", "Warum", "Wieso", "Weshalb", "Wofür", "Wofur", "Wie", "Which", "What", "Where", "When", "Who", "Whom", "Whose", "Why", "How")
_NAME = r"\p{Lu}[^\s.?!,;:]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def emails(question: Column) -> Column:
    """Addresses in a question, in order."""
    return F.regexp_extract_all(_text(question), F.lit(f"({EMAIL})"), F.lit(1))


def without_emails(question: Column) -> Column:
    return F.regexp_replace(_text(question), EMAIL, "")


# a straight pair; any curly or low opener with any of these or a straight closer; straight single
# quotes that begin a word, end one and hold white space. An opener without a closer takes all that follows
_CURLY = "‘’‚“”„"
_QUOTED = rf"""(?s)"[^"]*(?:"|$)|[{_CURLY}][^{_CURLY}"]*(?:[{_CURLY}"]|$)|(?<!\S)'(?:[^']|'(?=[\p{{L}}\p{{Nd}}]))*'(?![\p{{L}}\p{{Nd}}])"""


def _is_quoted(found: Column) -> Column:
    """Whether a match of _QUOTED is a phrase: its closer is there, and single quotes hold white space."""
    closed = (F.char_length(found) > 1) & found.rlike(rf"""(?s)^.*["'{_CURLY}]$""")
    return closed & (~F.startswith(found, F.lit("'")) | found.rlike(r"(?s)^'.*\s.*'$"))


def quoted_phrases(question: Column) -> Column:
    """What stands in quotes, in order, trimmed and with white space collapsed; empty ones go."""
    found = F.filter(F.regexp_extract_all(_text(question), F.lit(_QUOTED), F.lit(0)), _is_quoted)
    inner = F.transform(found, lambda x: F.trim(F.regexp_replace(F.substring(x, F.lit(2), F.char_length(x) - 2), r"\s+", " ")))
    return F.filter(inner, lambda x: x != "")


def without_quoted(question: Column) -> Column:
    """A question less its quoted phrases, white space collapsed. Quotes that hold no phrase stay."""
    found = F.filter(F.regexp_extract_all(_text(question), F.lit(_QUOTED), F.lit(0)), _is_quoted)
    left = F.aggregate(found, _text(question), lambda t, x: F.replace(t, x, F.lit(" ")))
    return F.trim(F.regexp_replace(left, r"\s+", " "))


def proper_nouns(question: Column) -> Column:
    """Runs of two or more capitalised words without punctuation between them; question words end a run."""
    plain = F.regexp_replace(_text(question), rf"(?<![^\s])(?:{'|'.join(QUESTION_WORDS)})(?![^\s.?!,;:])", "|")
    found = F.regexp_extract_all(plain, F.lit(rf"(?<![^\s])({_NAME}(?:\s+{_NAME})+)"), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " "))


def asks_for_entity(question: Column) -> Column:
    q = F.lower(F.trim(_text(question)))
    return q.rlike("^(?:" + "|".join(p.replace(" ", " ") for p in ENTITY_PREFIXES) + ")|" + "|".join(ENTITY_PARTS))


def graph_tokens(text: Column) -> Column:
    """Distinct runs of letters and digits of three bytes or more, case kept."""
    found = F.regexp_extract_all(_text(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda x: F.octet_length(x) >= 3))


def window_days(question: Column) -> Column:
    """Days that a question's "last n days, weeks or months" spans; yesterday 1, today 0, else null."""
    q = F.lower(_text(question))
    n, unit = (F.coalesce(*[F.when(F.regexp_extract(q, p, i) != "", F.regexp_extract(q, p, i)) for p in _WINDOWS]) for i in (1, 2))
    factor = F.when(unit.rlike("^(woche|week)"), 7).when(unit.rlike("^(monat|month)"), 30).otherwise(1)
    return F.coalesce(n.cast("int") * factor, F.when(q.rlike(r"\b(gestern|yesterday)\b"), 1).when(q.rlike(r"\b(heute|today)\b"), 0))


# fixed values: how a window of time is asked for
_WINDOWS = (r"\b(?:letzten?|vergangenen?)\s+(\d{1,3})\s+(tagen?|wochen?|monaten?)\b", r"\b(?:last|past)\s+(\d{1,3})\s+(days?|weeks?|months?)\b")


def citations(answer: Column) -> Column:
    """Numbers of [n] and [n, m] markers, in order."""
    groups = F.regexp_extract_all(_text(answer), F.lit(r"\[(\d+(?:\s*,\s*\d+)*)\]"), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, r"\s*,\s*"), lambda n: n.cast("int"))))


def word_grams(text: Column, n: int) -> Column:
    """Runs of n words of three characters or more, lower-cased."""
    words = F.filter(F.regexp_extract_all(F.lower(_text(text)), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.char_length(w) >= 3)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " ")))


def supported(sentence: Column, source: Column, n: int = 3) -> Column:
    """A sentence and a source share a run of n words."""
    return F.arrays_overlap(word_grams(sentence, n), word_grams(source, n))


def faithfulness(claims: Column, verdict: Column) -> Column:
    """1 less 0.2 for each unsupported claim, and 0.5 or 0.2 for a bad or weak verdict; 0 to 1."""
    worse = F.when(verdict == "bad", 0.5).when(verdict == "weak", 0.2).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.2 * F.coalesce(claims, F.lit(0)) - worse))


def memory_score(salience: Column, days: Column, decay: float, used: Column) -> Column:
    """Salience, less by age, more by use."""
    return salience * F.exp(-F.greatest(days, F.lit(0.0)) / decay) * (1 + F.log(1 + used))


def schema_score(hits: Column, overlap: Column, rows: Column) -> Column:
    return 1000 * hits + 10 * overlap + F.log10(rows + 1)


def injection_suspect(text: Column) -> Column:
    """Text that tells a reader's model what to do."""
    return F.lower(_text(text)).rlike(r"(?s)\b(?:ignore|disregard|forget)\b.{0,40}\b(?:previous|prior|above|earlier)\b.{0,40}\b(?:instructions?|prompts?|rules?)\b|\byou are now\b|\bsystem prompt\b|<\|im_start\|>|\bact as\b.{0,40}\b(?:admin|root|developer)\b")


def special_share(text: Column) -> Column:
    """Share of characters that are no letter, digit or white space; 0 of no text."""
    n = F.char_length(_text(text))
    return F.when(n == 0, 0.0).otherwise(F.char_length(F.regexp_replace(_text(text), r"[\p{L}\p{N}\s]", "")) / n)
