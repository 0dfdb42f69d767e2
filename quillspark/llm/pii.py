"""Personal data: fixed patterns, and further spans by weak supervision.

Fixed patterns give the base spans. Candidates for further spans (credentials, national
identifiers, local telephone numbers, spelled-out addresses, introduced names) are voted on
by labelers: a shape regex, a gazetteer of words that introduce such values, two context
labelers and a randomness labeler. Expectation-maximisation estimates each labeler's
reliability from the vote counts of the whole corpus, and a span classifier is trained on
the resulting probabilities, with features of the token beside the votes.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("secret", "national_id", "local_phone", "spelled_email", "name")
KINDS = BASE_KINDS + MORE_KINDS

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match that starts inside a run of digits fails whenever the run's start fails
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Words that introduce a value of each further kind.
GAZETTEER = {
    "secret": ("password", "passwd", "pwd", "passphrase", "secret", "token", "apikey", "api_key", "access_key", "credential", "pin"),
    "national_id": ("ssn", "social", "security", "passport", "iban", "account", "taxid", "nif", "steuer", "insee"),
    "local_phone": ("phone", "tel", "telephone", "mobile", "cell", "call", "fax", "telefon", "téléphone", "teléfono", "handy"),
    "spelled_email": ("email", "mail", "e-mail", "contact", "write", "reach", "correo", "courriel"),
    "name": ("mr", "mrs", "ms", "dr", "herr", "frau", "señor", "señora", "monsieur", "madame"),
}
#: Words before a value that is no personal data.
OTHER_CONTEXT = ("version", "isbn", "issn", "doi", "commit", "sha", "sha256", "md5", "checksum", "order", "invoice", "page", "chapter", "license", "rfc", "build", "release")
#: Words of first-person or contact sentences.
PERSONAL_CONTEXT = ("my", "your", "his", "her", "our", "contact", "login", "user", "username", "account", "me", "mein", "meine", "mon", "ma", "mi", "is", "=", ":")

# values are matched whole, by possessive quantifiers: no length limit, and no match is tried again
_ASSIGNED = re.compile(r"(?i)\b(?:password|passwd|pwd|passphrase|secret|token|api_?key|access_key|credential)\b\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,}+)")
_MIXED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Za-z]++[0-9]|[0-9]++[A-Za-z])[A-Za-z0-9]{12,}+")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_SPELLED_AT = re.compile(r"(?i)[\[(]\s?at\s?[\])]")
_SPELLED = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]++(?:\s?(?:[\[(]\s?dot\s?[\])]|\.)\s?[A-Za-z0-9-]++)++")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Señora?|Monsieur|Madame)\b\.?\s([A-ZÀ-Þ][\w'-]++(?:\s[A-ZÀ-Þ][\w'-]++)?)")
_KEY_SHAPE = re.compile(r"(?:AKIA|ASIA|ghp_|sk_|xox)[A-Za-z0-9_]{12,}|[0-9a-f]{32,}|[0-9a-f]{18}")
_LABELERS = 5
Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the fixed patterns by kind and start, in code points."""
    out: list[Span] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = at = m.end()
        else:
            at += 1
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and _is_card(m.group())]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _is_card(found: str) -> bool:
    digits = [int(c) for c in found if c not in " -"]
    if not 13 <= len(digits) <= 19:
        return False
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, pattern) of possible further spans, by start; none touches a base span
    or an earlier candidate. pattern numbers the votes and features."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [(4, *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if _DIGIT.search(text):
        found += [(5, *m.span()) for x in (_SSN, _IBAN) for m in x.finditer(text)]
        found += [(4, *m.span()) for m in _MIXED.finditer(text)]
        found += [(6, *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    if _SPELLED_AT.search(text):
        found += [(7, *m.span()) for m in _SPELLED.finditer(text)]
    found += [(8, *m.span(1)) for m in _NAME.finditer(text)]
    if not found:
        return []
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], [0, *accumulate((e for _, e in taken), max)]
    out = []
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        if reach[bisect_left(starts, end)] <= start and (not out or start >= out[-1][2]):
            out.append((kind, start, end, _pattern(text, kind, start, end)))
        elif kind == 4 and out and out[-1][:2] == (4, start) and reach[bisect_left(starts, end)] <= start:
            out[-1] = (4, start, end, out[-1][3])  # of an assigned value, more than its first run of letters and digits
    return out


def votes(text: str, kind: int, start: int, end: int) -> list[int]:
    """Each labeler's vote: 1 personal, -1 not, 0 no opinion."""
    value, name = text[start:end], KINDS[kind]
    before = re.findall(r"[\w-]+|[=:]", text[max(0, start - 40) : start].lower())[-4:]
    near = set(before)
    shape = {4: bool(_KEY_SHAPE.fullmatch(value)), 5: bool(_SSN.fullmatch(value)) or _is_iban(value), 6: value.startswith("(") or "-" in value, 7: "dot" in value.lower(), 8: " " in value}[kind]
    counts = Counter(value.lower())
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    random = bits >= 3.2 and any(c.isdigit() for c in value)
    return [
        1 if shape else -1 if kind in (4, 5) else 0,
        1 if near & set(GAZETTEER[name]) else 0,
        -1 if near & set(OTHER_CONTEXT) else 0,
        1 if near & set(PERSONAL_CONTEXT) else 0,
        (1 if random else -1 if bits < 2.2 or kind == 4 and value.isalpha() else 0) if kind in (4, 5) else 0,
    ]


def _is_iban(value: str) -> bool:
    moved = value[4:] + value[:4]
    return value[:2].isalpha() and value.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _features(text: str, start: int, end: int) -> list[bool]:
    value = text[start:end]
    digits = sum(c.isdigit() for c in value)
    return [len(value) >= 12, len(value) >= 24, digits * 2 >= len(value), value.isupper(), start > 0 and text[start - 1] in "\"'=", value.isalnum()]


def _pattern(text: str, kind: int, start: int, end: int) -> int:
    code = kind - len(BASE_KINDS)
    for v in votes(text, kind, start, end):
        code = 3 * code + v + 1
    for f in _features(text, start, end):
        code = 2 * code + f
    return code


def _read_pattern(code: int) -> tuple[int, list[int], list[int]]:
    flags = []
    for _ in range(6):
        code, f = divmod(code, 2)
        flags.append(f)
    said = []
    for _ in range(_LABELERS):
        code, v = divmod(code, 3)
        said.append(v - 1)
    return code, said[::-1], flags[::-1]


def estimate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """Pattern -> probability that it is personal data, by expectation-maximisation over each
    kind's votes: a rate of saying 1, -1 and 0 for each labeler and class."""
    out: dict[int, float] = {}
    read = {c: _read_pattern(c) for c in counts}
    for kind in {r[0] for r in read.values()}:
        codes = sorted(c for c in counts if read[c][0] == kind)
        said = np.array([read[c][1] for c in codes])
        n = np.array([counts[c] for c in codes], dtype=float)
        p = 1 / (1 + np.exp(-1.5 * said.sum(axis=1)))  # majority, to begin with
        for _ in range(rounds):
            share = (n @ p + 1) / (n.sum() + 2)
            logit = np.full(len(codes), math.log(share / (1 - share)))
            for j in range(said.shape[1]):
                for v in (-1, 0, 1):
                    says = said[:, j] == v
                    # smoothed towards labelers that are right more often than not
                    yes = (n[says] @ p[says] + (4 if v == 1 else 1 if v == -1 else 3)) / (n @ p + 8)
                    no = (n[says] @ (1 - p[says]) + (1 if v == 1 else 4 if v == -1 else 3)) / (n @ (1 - p) + 8)
                    logit[says] += math.log(yes / no)
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out |= dict(zip(codes, p.tolist(), strict=True))
    return out


def train_classifier(counts: dict[int, int], rounds: int = 300) -> frozenset[int]:
    """Patterns that the span classifier accepts: logistic regression on kind, votes and
    features, weighted by counts, with the estimated probabilities as soft labels."""
    if not counts:
        return frozenset()
    codes = sorted(counts)
    soft = estimate(counts)
    y = np.array([soft[c] for c in codes])
    n = np.array([counts[c] for c in codes], dtype=float)
    rows = []
    for kind, said, flags in map(_read_pattern, codes):
        rows.append([1.0, *(float(kind == k) for k in range(len(MORE_KINDS))), *(float(v > 0) for v in said), *(float(v < 0) for v in said), *flags])
    x = np.array(rows)
    w = np.zeros(x.shape[1])
    weight = n / n.sum() * len(n)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (weight * (p - y)) + 0.01 * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return frozenset(c for c, z in zip(codes, x @ w, strict=True) if z >= 0)


def fit(docs: DataFrame, text_col: str = "text") -> frozenset[int]:
    """The accepted patterns, from the candidates of every text. What is collected is a count
    per pattern: kinds, votes and features make at most 5 * 3^5 * 2^6 of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[int] = Counter()
            for t in b.column(0):
                text = t.as_py() or ""
                seen.update(c[3] for c in candidates(text, base_spans(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "pattern long, n long")
    return train_classifier({r.pattern: r.n for r in counted.groupBy("pattern").agg(F.sum("n").alias("n")).collect()})


def spans(text: str | None, accepted: frozenset[int]) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans by kind and start) of a text."""
    base = base_spans(text or "")
    return base, base + sorted(c[:3] for c in candidates(text or "", base) if c[3] in accepted)


def _joined(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in found)


def find(docs: DataFrame, accepted: frozenset[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): a row per row of docs.

    The counts are of base spans, whose kinds no further span has. Null text counts as
    empty: no spans, the digest of an empty string. Null and repeated ids keep their rows;
    other columns of docs are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [spans(t.as_py(), accepted) for t in b.column(1)]
            counts = [Counter(k for k, _, _ in base) for base, _ in both]
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(BASE_KINDS))]
            digests = pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in both], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, digests, pa.array([_joined(a) for _, a in both], pa.string())], names=["id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)


def redacted(text: str, accepted: frozenset[int]) -> str:
    """text with each span replaced by its kind in brackets; of overlapping spans the earliest, then longest."""
    out, at = [], 0
    for start, end, kind in sorted(((s, e, k) for k, s, e in spans(text, accepted)[1]), key=lambda x: (x[0], -x[1])):
        if start < at:
            at = max(at, end)  # what the overlapping span also covers goes too
            continue
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:] if out else text


def redact_column(accepted: frozenset[int], text: Column) -> Column:
    """Redacted text; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, accepted) for t in texts], dtype=object)

    return F.pandas_udf(run, "string")(text.cast("string"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; rows, order of columns and other columns stay."""
    accepted = fit(docs, text_col)
    return docs.withColumn(text_col, redact_column(accepted, F.col(text_col)))
