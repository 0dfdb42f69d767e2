"""Order-dependent choices within one query's candidates, a bounded number of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType


def _words(text: str | None) -> frozenset[str]:
    return frozenset((text or "").lower().split())


def _jaccard(a: frozenset[str], b: frozenset[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def without_near_copies(candidates: DataFrame, most: float = 0.85) -> DataFrame:
    """Rows (query_id, id, group_id, rank, text, score) in rank order, without those whose words are
    more than `most` like a kept row's of the same group; an empty group is compared with all."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[str, frozenset[str]]] = []
        stay = []
        for r in rows.sort_values(["rank", "id"]).itertuples():
            words, group = _words(r.text), r.group_id or ""
            if any((not group or not g or g == group) and _jaccard(words, w) > most for g, w in kept):
                continue
            kept.append((group, words))
            stay.append(r.Index)
        return rows.loc[stay]

    return candidates.groupBy("query_id").applyInPandas(one, candidates.schema)


def diversified(candidates: DataFrame, k: int, weight: float = 0.7, across: float = 0.2) -> DataFrame:
    """k rows of each query by maximal marginal relevance: weight * score - (1 - weight) * the
    greatest likeness to a chosen row, which counts `across` between groups; an empty group is the
    same as any. weight is held to 0..1, and 1 keeps the order. Adds pick from 1."""
    weight = min(max(weight, 0.0), 1.0)

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["rank", "id"]).reset_index(drop=True)
        words = [_words(t) for t in rows.text]
        left, chosen = list(range(len(rows))), []
        alike = lambda a, b: not a or not b or a == b
        while left and len(chosen) < k:

            def gain(i: int) -> float:
                likeness = max((_jaccard(words[i], words[j]) * (1 if alike(rows.group_id[i], rows.group_id[j]) else across) for j in chosen), default=0.0)
                return weight * rows.score[i] - (1 - weight) * likeness

            best = left[0] if not chosen or weight == 1 else max(left, key=lambda i: (gain(i), -i))
            chosen.append(best)
            left.remove(best)
        return rows.loc[chosen].assign(pick=range(1, len(chosen) + 1))

    return candidates.groupBy("query_id").applyInPandas(one, StructType([*candidates.schema, StructField("pick", LongType())]))


def within_budget(candidates: DataFrame, budget: int) -> DataFrame:
    """Rows (query_id, id, score, tokens, pos) that fit a token budget: best score first, one that
    doesn't fit is skipped; the order of pos stays."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        room, stay = budget, []
        for r in rows.sort_values(["score", "id"], ascending=[False, True]).itertuples():
            if r.tokens <= room:
                room -= r.tokens
                stay.append(r.Index)
        return rows.loc[stay].sort_values("pos")

    return candidates.groupBy("query_id").applyInPandas(one, candidates.schema)
