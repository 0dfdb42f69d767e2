"""Toxicity scores by a counterfactual-regularised linear classifier."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillspark.llm.common import stored

_WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6)  # characters of the word beginnings that are features beside whole words

#: Terms that name groups of people; those of a set replace one another.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girls", "boys"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("frauen", "männer"),
    ("christen", "muslime", "juden"),
    ("femmes", "hommes"),
    ("chrétiens", "musulmans", "juifs"),
    ("mujeres", "hombres"),
    ("cristianos", "musulmanes", "judíos"),
)
_SWAP = {t: s for s in IDENTITY_TERMS for t in s}


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features(found: list[str]) -> set[str]:
    """Whole words, and the beginnings of longer ones marked with a caret."""
    distinct = set(found)
    return distinct.union(*({"^" + w[:n] for w in distinct if len(w) > n} for n in PREFIXES))


def counterfactual(found: list[str]) -> list[str] | None:
    """The words with each identity term exchanged for another of its set; None if there is none."""
    if _SWAP.keys().isdisjoint(found):
        return None
    return [s[(s.index(w) + 1 + zlib.crc32(w.encode()) % (len(s) - 1)) % len(s)] if (s := _SWAP.get(w)) else w for w in found]


def likeness(found: list[str]) -> int:
    """Least hash of five-word runs: copies of a document mostly share it."""
    return min((zlib.crc32(" ".join(found[i : i + 5]).encode()) for i in range(max(1, len(found) - 4))), default=0)


@dataclass
class Model:
    """logit = bias + the weights of the features present."""

    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, text: str | None) -> float:
        look = self.weights.get
        distinct = set(_WORD.findall((text or "").lower()))
        z = self.bias + sum(look(w, 0.0) for w in distinct)
        for n in PREFIXES:
            z += sum(look("^" + p, 0.0) for p in {w[:n] for w in distinct if len(w) > n})
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def held_out(id_: Column) -> Column:
    return F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, y): about `most` labelled ids at most, by hash; held-out ids and null labels left out."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    share = min(1.0, most / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_rows: int = 20_000, most_features: int = 4000, least_gain: float = 14.0, ridge: float = 1.0, fairness: float = 10.0) -> Model:
    """Fit on a sample of at most about `most_rows` labelled rows that aren't held out.

    Rows that share a likeness count once. The `most_features` features with the largest
    likelihood ratio between the labels (at least least_gain) are kept, and all identity
    terms. The loss is logistic, plus ridge * (w / log odds)^2, plus fairness times the squared change
    of the logit between a text and its copy with identity terms exchanged. Without rows of
    both labels the model is the smoothed base rate.
    """
    sample = F.broadcast(labelled_sample(labels, id_col, label_col, most_rows))  # bounded by most_rows
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).join(sample, "id")
    found = stored(found.mapInArrow(_featured, "id string, y int, likeness long, present array<string>, swapped array<string>"))
    first = F.row_number().over(Window.partitionBy("likeness").orderBy(F.desc("y"), "id", F.hash("present")))
    rows = found.withColumn("__r", first).where("__r = 1").drop("__r")
    totals = rows.agg(F.count("*"), F.sum("y")).first()
    n, positive = int(totals[0]), int(totals[1] or 0)
    if not 0 < positive < n:
        return Model(float(np.log((positive + 0.5) / (n - positive + 0.5))))
    a = F.col("a").cast("double")  # rows with the feature, and of those y = 1
    counted = rows.select("y", F.explode("present").alias("f")).groupBy("f").agg(F.count("*").alias("a"), F.sum("y").cast("double").alias("p"))

    def part(seen: Column, rate: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / rate)).otherwise(0.0)

    rate = positive / n
    gain = 2 * (part(F.col("p"), a * rate) + part(a - F.col("p"), a * (1 - rate)) + part(positive - F.col("p"), (n - a) * rate) + part((n - a) - (positive - F.col("p")), (n - a) * (1 - rate)))
    best = counted.where("a >= 3").withColumn("g", gain).where(F.col("g") >= least_gain).orderBy(F.desc("g"), "f").limit(most_features)
    names = sorted({r.f for r in best.select("f").collect()} | {t for s in IDENTITY_TERMS for t in s})
    kept = F.lit(names)
    narrow = rows.select("y", F.array_intersect("present", kept).alias("x"), F.array_intersect("swapped", kept).alias("s"))
    number = {f: i for i, f in enumerate(names)}
    data = [(r.y, [number[f] for f in r.x], None if r.s is None else [number[f] for f in r.s]) for r in narrow.collect()]  # most_rows short lists
    bias, weights = _fit(data, len(names), ridge, fairness)
    return Model(bias, {f: float(w) for f, w in zip(names, weights, strict=True) if w})


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [words(t.as_py()) for t in b.column("t")]
        swapped = [counterfactual(w) for w in found]
        columns = [
            b.column("id").cast(pa.string()),
            b.column("y").cast(pa.int32()),
            pa.array([likeness(w) for w in found], pa.int64()),
            pa.array([sorted(features(w)) for w in found], pa.list_(pa.string())),
            pa.array([None if w is None else sorted(features(w)) for w in swapped], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "y", "likeness", "present", "swapped"])


def _fit(data: list, width: int, ridge: float, fairness: float, rounds: int = 400, rate: float = 0.1) -> tuple[float, np.ndarray]:
    """Full-batch Adam on the sparse rows."""

    def sparse(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter((i for x in lists for i in x), dtype=np.int64)

    y = np.array([d[0] for d in data], dtype=float)
    row, col = sparse([d[1] for d in data])
    pairs = [(d[1], d[2]) for d in data if d[2] is not None]
    prow, pcol = sparse([p[0] for p in pairs])
    srow, scol = sparse([p[1] for p in pairs])
    w, b = np.zeros(width), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    # each feature scaled by its smoothed log odds: what both labels share stays small
    ones = np.bincount(col, y[row], width)
    odds = (ones + 0.5) / (np.bincount(col, minlength=width) - ones + 0.5)
    scale = np.maximum(np.abs(np.log(odds) - b), 0.1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(y)), -35, 35)))
        g = np.bincount(col, (p - y)[row], width) + ridge * w / scale**2
        if pairs:
            change = np.bincount(prow, w[pcol], len(pairs)) - np.bincount(srow, w[scol], len(pairs))
            g += fairness * (np.bincount(pcol, change[prow], width) - np.bincount(scol, change[srow], width))
        g = np.append(g, (p - y).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return float(b), w


def score_column(model: Model, text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return F.pandas_udf(run, "double")(text.cast("string"))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **training) -> DataFrame:
    """(id, held_out, score, predicted): a row per row of docs; the score depends on the text alone.

    Null text scores as empty text. A null id is hashed as empty text for held_out. Equal
    texts get equal scores. Other columns of docs are not read; an empty table gives an
    empty result.
    """
    model = train(docs, labels, id_col, text_col, label_col, **training)
    out = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), score_column(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, **training) -> DataFrame:
    """The rows of docs that score below the threshold, with docs' columns."""
    model = train(docs, labels, id_col, text_col, label_col, **training)
    return docs.where(score_column(model, F.col(text_col)) < threshold)
