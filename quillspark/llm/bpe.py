"""Byte-level BPE on padded matrices of equal-length words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.encoders import ByteBpe, gathered, rank_file, slices

_NONE = np.int32(2**31 - 1)
_BUCKETS = np.array([2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512])
_ROWS = 1 << 16  # rows of a matrix at a time


class PairTable:
    """(left id, right id) -> rank of their joined bytes, by open addressing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        keys = np.fromiter(pairs, dtype=np.uint64, count=len(pairs))
        ranked = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.ranks = np.full(1 << bits, _NONE)
        slot = self._slot(keys)
        while len(keys):  # the first key of each free slot settles, the others step on
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            settles = np.zeros(len(keys), dtype=bool)
            settles[first] = True
            settles &= free
            self.keys[slot[settles]], self.ranks[slot[settles]] = keys[settles], ranked[settles]
            keys, ranked, slot = keys[~settles], ranked[~settles], (slot[~settles] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; padding (-1) and unknown pairs have none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64) & np.uint64(0xFFFFFFFF)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], _NONE)
        open_ = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(open_):
            slot[open_] = (slot[open_] + np.uint64(1)) & self.mask
            seen = self.keys[slot[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (seen != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = _NONE
        return out


def merge_rows(tokens: np.ndarray, table: PairTable) -> np.ndarray:
    """Rows of ids padded with -1 at the end, merged until no row has a known pair.

    Each round, every open row merges its leftmost pair of least rank; rows close up by one
    column, and finished rows leave the matrix.
    """
    n, width = tokens.shape
    done = np.full((n, width), -1, dtype=np.int32)
    rows = np.arange(n)
    ranks = table.rank(tokens[:, :-1].ravel(), tokens[:, 1:].ravel()).reshape(n, width - 1)
    while len(rows):
        at = ranks.argmin(axis=1)
        least = ranks[np.arange(len(rows)), at]
        ends = least == _NONE
        if ends.any():
            done[rows[ends], : tokens.shape[1]] = tokens[ends]
            rows, tokens, ranks, at, least = rows[~ends], tokens[~ends], ranks[~ends], at[~ends], least[~ends]
            if not len(rows):
                break
        every = np.arange(len(rows))
        tokens[every, at] = least
        if tokens.shape[1] == 2:
            done[rows, 0] = tokens[:, 0]
            break
        columns = np.arange(tokens.shape[1] - 1)
        tokens = np.take_along_axis(tokens, columns + (columns > at[:, None]), axis=1)
        columns = columns[:-1]
        ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
        inner = at > 0
        ranks[every[inner], at[inner] - 1] = table.rank(tokens[every[inner], at[inner] - 1], tokens[every[inner], at[inner]])
        inner = at < ranks.shape[1]
        ranks[every[inner], at[inner]] = table.rank(tokens[every[inner], at[inner]], tokens[every[inner], at[inner] + 1])
    return done


def merge_long(tokens: np.ndarray, table: PairTable) -> np.ndarray:
    """One long row: a round merges all pairs of least rank, from the left, as single merges
    would in turn; should a new pair outrank them, only the leftmost is merged."""
    while len(tokens) > 1:
        ranks = table.rank(tokens[:-1], tokens[1:])
        least = ranks.min()
        if least == _NONE:
            break
        at = np.flatnonzero(ranks == least)
        run = np.concatenate(([True], np.diff(at) > 1))
        begins = np.maximum.accumulate(np.where(run, at, 0))
        at = at[(at - begins) % 2 == 0]
        merged = _merged(tokens, at, least)
        new = table.rank(merged[:-1], merged[1:])
        if len(at) > 1 and len(new) and new.min() < least:
            merged = _merged(tokens, at[:1], least)
        tokens = merged
    return tokens


def _merged(tokens: np.ndarray, at: np.ndarray, rank: np.int32) -> np.ndarray:
    out = tokens.copy()
    out[at] = rank
    return np.delete(out, at + 1)


class MatrixBpe(ByteBpe):
    """Encoding and decoding by a rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.table, self.pattern = ranks, PairTable(ranks), regex.compile(pattern)
        self.added, self.special, self.library, self.feed = {}, "", None, ranks[b"\n"]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token

    def ordinary(self, text: str) -> np.ndarray:
        found = self.pattern.findall(text)
        if not found:
            return np.empty(0, "<u4")
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        ids, starts, lengths = self.words([w.encode() for w in coded.dictionary.to_pylist()])
        return gathered(ids, starts, lengths, coded.indices.to_numpy())[0]

    def whole(self, text: str) -> np.ndarray:
        return self.ordinary(text)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids in a row, start of each word's, their number). A word in the file is its own id."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        lengths = np.ones(len(words), dtype=np.int32)
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype("<u4"))]
        bucket = np.searchsorted(_BUCKETS, sizes)
        bucket[whole >= 0] = -1
        for k in np.unique(bucket[bucket >= 0]).tolist():
            members = np.flatnonzero(bucket == k)
            if k == len(_BUCKETS):
                for i in members.tolist():
                    ids = merge_long(self.of_byte[np.frombuffer(words[i], dtype=np.uint8)], self.table)
                    lengths[i] = len(ids)
                    parts.append((np.array([i]), ids.astype("<u4")))
                continue
            width = int(_BUCKETS[k])
            for at in range(0, len(members), _ROWS):
                some = members[at : at + _ROWS]
                raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in some.tolist()]), dtype=np.uint8).reshape(-1, width)
                filled = np.arange(width) < sizes[some][:, None]
                merged = merge_rows(np.where(filled, self.of_byte[raw], np.int32(-1)), self.table)
                lengths[some] = (merged >= 0).sum(axis=1)
                parts.append((some, merged[merged >= 0].astype("<u4")))
        starts = np.empty(len(words), dtype=np.int32)
        at = 0
        for some, ids in parts:
            starts[some] = at + np.cumsum(lengths[some]) - lengths[some]
            at += len(ids)
        return np.concatenate([ids for _, ids in parts]), starts, lengths

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])


@lru_cache(maxsize=2)
def matrix_bpe(path: str, pattern: str) -> MatrixBpe:
    return MatrixBpe(rank_file(path), pattern)


def encode(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the ids of each whole text. Null text: no ids. Repeated rows keep a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = matrix_bpe(rank_path, pattern), 0
        for b in batches:
            at = 0
            for some in slices(b.column(1)):
                ids, bounds = own.encode(some)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["id", "ids"])
                at += len(some)

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {id_type}, ids array<int>")


def decode(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(id, ids) -> (id, bytes): what the ids stand for. Null ids: null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matrix_bpe(rank_path, pattern)
        for b in batches:
            out = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["id", "bytes"])

    return encoded.select("id", "ids").mapInArrow(run, f"id {encoded.schema['id'].dataType.simpleString()}, bytes binary")


def encode_decode_digests(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text and decodes its ids again.

    Null and empty texts: no ids, digests of no bytes. Other columns of docs are not read;
    null and repeated ids keep their rows; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = matrix_bpe(rank_path, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for some in slices(pc.fill_null(b.column(1), "")):
                ids, bounds = own.encode(some)
                for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n.append(y - x)
                    of_ids.append(hashlib.sha256(ids[x:y]).hexdigest())
                    of_bytes.append(hashlib.sha256(own.decode(ids[x:y])).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, schema)
