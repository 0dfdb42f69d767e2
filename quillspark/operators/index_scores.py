"""BM25 over postings of a stored index, document by document: phrases and scores are found where a document's postings are."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_AT_ONCE = 1 << 19  # postings whose documents are scored together; a longer document is taken by itself
_CELLS = 1 << 21  # scores held at once


def _starts(sorted_: np.ndarray, n: int) -> np.ndarray:
    """Where each of the numbers 0 to n - 1 begins in a sorted array, and, last, where it ends."""
    return np.searchsorted(sorted_, np.arange(n + 1))


def _spread(starts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, at): each entry of `of` by its place, as often as its list has members, and the members' places."""
    few = starts[of + 1] - starts[of]
    at = np.repeat(starts[of] - np.cumsum(few) + few, few) + np.arange(few.sum())
    return np.repeat(np.arange(len(of)), few), at


class Phrases:
    """Phrases as a tree of words: `steps` lead from a phrase's beginning and a next word to a longer beginning."""

    def __init__(self, phrases: list[tuple[int, list[int]]], n_codes: int) -> None:
        """phrases: (query, codes of its words); n_codes bounds the codes."""
        known: dict[tuple[int, int], int] = {}
        ends: list[tuple[int, int]] = []
        self.longest = 0
        for query, codes in phrases:
            node = 0
            for depth, code in enumerate(codes):
                node = known.setdefault((node, code), len(known) + 1)
                self.longest = max(self.longest, depth + 1)
            ends.append((node, query))
        keys = np.array([a * n_codes + c for a, c in known], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes, self.n_codes = keys[order], np.arange(1, len(known) + 1)[order], n_codes
        ends.sort()
        self.queries = np.array([q for _, q in ends], np.int64)
        self.starts = _starts(np.array([e for e, _ in ends], np.int64), len(known) + 1)

    def held(self, owner: np.ndarray, place: np.ndarray, code: np.ndarray, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, counts): owner * n_queries + query, and how many of the query's phrases the owner's words hold, of
        words in order of owner and place."""
        at, node = np.arange(len(code)), np.zeros(len(code), np.int64)
        ended = []
        for depth in range(self.longest):
            if depth:
                on = at + depth < len(code)
                at, node = at[on], node[on]
                on = (owner[at + depth] == owner[at]) & (place[at + depth] == place[at] + depth)
                at, node = at[on], node[on]
            key = node * self.n_codes + code[at + depth]
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[i] == key
            at, node = at[on], self.nodes[i[on]]
            ends = self.starts[node + 1] > self.starts[node]
            ended.append(np.unique(owner[at[ends]] * (len(self.keys) + 1) + node[ends]))
        ended_ = np.concatenate(ended) if ended else np.zeros(0, np.int64)
        whose, node = ended_ // (len(self.keys) + 1), ended_ % (len(self.keys) + 1)
        which, member = _spread(self.starts, node)
        return np.unique(whose[which] * n_queries + self.queries[member], return_counts=True)


@dataclass
class Asked:
    """What a set of queries asks: query numbers, and (query, code) pairs with idf and whether any part but a phrase names it."""

    n_queries: int
    n_codes: int
    corpus: np.ndarray  # of each query
    n_phrases: np.ndarray
    loose_parts: np.ndarray
    avgdl: np.ndarray
    query: np.ndarray  # of each pair
    code: np.ndarray
    idf: np.ndarray
    loose: np.ndarray
    phrases: list[tuple[int, list[int]]]
    k: int
    k1: float
    b: float

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query, id, score) of the k best documents of the rows' documents, of rows (corpus, id, batch, code, tf, dl,
        positions) that hold each document's together: its versions, with code -1 and tf 1 if deleted, and its postings."""
        scorer = _Scorer(self)
        parts: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            if not len(b):
                continue
            corpus, ids = b.column(0).to_numpy(), b.column(1).to_numpy()
            news = np.flatnonzero((corpus[1:] != corpus[:-1]) | (ids[1:] != ids[:-1])) + 1
            if parts and (parts[-1].column(0)[-1].as_py(), parts[-1].column(1)[-1].as_py()) != (corpus[0], ids[0]):
                news = np.append(0, news)
            if held + len(b) >= _AT_ONCE and len(news):
                cut = int(news[-1])
                scorer.add(pa.Table.from_batches([*parts, b.slice(0, cut)]))
                parts, held = [b.slice(cut)], len(b) - cut
            else:
                parts.append(b)
                held += len(b)
        if held:
            scorer.add(pa.Table.from_batches(parts))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in scorer.best], names=["query", "id", "score"])


class _Scorer:
    def __init__(self, asked: Asked) -> None:
        self.asked = asked
        self.tree = Phrases(asked.phrases, asked.n_codes) if asked.phrases else None
        self.best = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0))
        by_query = np.lexsort((asked.code, asked.query))
        self.of_query, self.query_starts = by_query, _starts(asked.query[by_query], asked.n_queries)
        # queries without phrases, by code; each has a column of its own among those of its corpus
        plain = np.flatnonzero(asked.n_phrases[asked.query] == 0)
        self.of_code = plain[np.argsort(asked.code[plain], kind="stable")]
        self.code_starts = _starts(asked.code[self.of_code], asked.n_codes)
        queries = np.flatnonzero(asked.n_phrases == 0)
        queries = queries[np.argsort(asked.corpus[queries], kind="stable")]
        n_corpora = int(asked.corpus.max()) + 1
        first = _starts(asked.corpus[queries], n_corpora)
        self.width = max(1, int(np.diff(first).max()))
        self.column = np.zeros(asked.n_queries, np.int64)
        self.column[queries] = np.arange(len(queries)) - first[asked.corpus[queries]]
        self.of_column = np.full((n_corpora, self.width), -1, np.int64)
        self.of_column[asked.corpus[queries], self.column[queries]] = queries
        self.idf, self.avgdl = np.zeros(asked.n_codes), np.ones(n_corpora)
        self.idf[asked.code], self.avgdl[asked.corpus] = asked.idf, asked.avgdl
        # lexemes that many queries ask for are rows of a matrix for their corpus; the others go by lists
        many = np.diff(self.code_starts) >= max(8, self.width // 32)
        self.row, self.common = np.full(asked.n_codes, -1, np.int64), []
        of_pair = asked.corpus[asked.query[self.of_code]]
        for c in range(n_corpora):
            mine = self.of_code[(of_pair == c) & many[asked.code[self.of_code]]]
            codes, row = np.unique(asked.code[mine], return_inverse=True)
            self.row[codes] = np.arange(len(codes))
            self.common.append(np.zeros((len(codes), self.width)))
            self.common[-1][row, self.column[asked.query[mine]]] = 1.0

    def add(self, met: pa.Table) -> None:
        corpus, ids, batch, code, tf, dl = (met[n].to_numpy() for n in ("corpus", "id", "batch", "code", "tf", "dl"))
        new = np.concatenate(([True], (corpus[1:] != corpus[:-1]) | (ids[1:] != ids[:-1])))
        owner, heads = np.cumsum(new) - 1, np.flatnonzero(new)
        version = np.flatnonzero(code < 0)
        version = version[np.lexsort((batch[version], owner[version]))]
        current = np.full(len(heads), -2, np.int64)  # the last of a document's versions counts
        current[owner[version]] = np.where(tf[version] == 1, -2, batch[version])
        rows = np.flatnonzero((code >= 0) & (batch == current[owner]))
        rows = rows[np.lexsort((code[rows], owner[rows]))]
        owner, code, tf, dl = owner[rows], code[rows].astype(np.int64), tf[rows].astype(float), dl[rows].astype(float)
        if not len(rows):
            return
        if self.width and len(self.of_code):
            self._plain(corpus[heads], ids[heads], owner, code, tf, dl)
        if self.tree:
            self._phrased(ids[heads], owner, code, tf, dl, met["positions"].combine_chunks().take(pa.array(rows)))

    def _weight(self, pair: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        a = self.asked
        return a.idf[pair] * tf * (a.k1 + 1) / (tf + a.k1 * (1 - a.b + a.b * dl / a.avgdl[a.query[pair]]))

    def _plain(self, corpus: np.ndarray, ids: np.ndarray, owner: np.ndarray, code: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> None:
        a, by = self.asked, np.argsort(corpus, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        order = np.argsort(place[owner], kind="stable")
        owner, code, tf, dl, ids = place[owner][order], code[order], tf[order], dl[order], ids[by]
        bounds = _starts(corpus[by], len(self.common))
        for c, common in enumerate(self.common):
            step = max(1, _CELLS // max(self.width, len(common)))
            for at in range(bounds[c], bounds[c + 1], step):
                n = min(step, bounds[c + 1] - at)
                some = slice(*np.searchsorted(owner, (at, at + n)))
                mine, row = owner[some] - at, self.row[code[some]]
                weight = self.idf[code[some]] * tf[some] * (a.k1 + 1) / (tf[some] + a.k1 * (1 - a.b + a.b * dl[some] / self.avgdl[c]))
                cells = np.zeros((n, len(common)))
                cells[mine[row >= 0], row[row >= 0]] = weight[row >= 0]
                which, member = _spread(self.code_starts, code[some][row < 0])
                at_cell = mine[row < 0][which] * self.width + self.column[a.query[self.of_code[member]]]
                score = cells @ common + np.bincount(at_cell, weights=weight[row < 0][which], minlength=n * self.width).reshape(n, self.width)
                least = np.partition(score, n - a.k, axis=0)[n - a.k] - 2e-6 if n > a.k else np.zeros(self.width)
                doc, column = np.nonzero((score >= least) & (score > 0))
                self._offer(self.of_column[c, column], ids[at + doc], score[doc, column])

    def _phrased(self, ids: np.ndarray, owner: np.ndarray, code: np.ndarray, tf: np.ndarray, dl: np.ndarray, positions: pa.ListArray) -> None:
        a = self.asked
        n = np.nan_to_num(positions.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        place = positions.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        whose, word = np.repeat(owner, n), np.repeat(code, n)
        order = np.lexsort((place, whose))
        keys, counts = self.tree.held(whose[order], place[order], word[order], a.n_queries)
        keys = keys[counts == a.n_phrases[keys % a.n_queries]]
        own = owner * a.n_codes + code  # in order
        step = 1 << 18
        for at in range(0, len(keys), step):
            some = keys[at : at + step]
            which, member = _spread(self.query_starts, some % a.n_queries)
            pair = self.of_query[member]
            wanted = (some // a.n_queries)[which] * a.n_codes + a.code[pair]
            i = np.minimum(np.searchsorted(own, wanted), len(own) - 1)
            there = own[i] == wanted
            which, pair, i = which[there], pair[there], i[there]
            score = np.bincount(which, weights=self._weight(pair, tf[i], dl[i]), minlength=len(some))
            loose = np.bincount(which, weights=a.loose[pair], minlength=len(some)) > 0
            good = loose | (a.loose_parts[some % a.n_queries] == 0)
            self._offer((some % a.n_queries)[good], ids[(some // a.n_queries)[good]], score[good])

    def _offer(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Keeps each query's k best so far, ties to smaller ids."""
        query, ids, score = np.concatenate((self.best[0], query)).astype(np.int32), np.concatenate((self.best[1], ids)), np.concatenate((self.best[2], np.round(score, 6)))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.zeros(0, np.int64)
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        order, query = order[nth < self.asked.k], query[nth < self.asked.k]
        self.best = query, ids[order], score[order]
