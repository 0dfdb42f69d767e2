"""Encoders of public tokenizer files for use inside tasks, a column of texts at a time.

A worker process opens a file once. With byte-level BPE files a batch is cut at single
spaces and line feeds, where the split pattern always starts a new match; the distinct
pieces of the batch are encoded once, and their ids are gathered for every text.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACES = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_UNEVEN = f"{_SPACES}{_SPACES}|^{_SPACES}|{_SPACES}$"
_AT_ONCE = 4 << 20  # bytes of text whose pieces are held together


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: bytes that print stand for
    themselves, the others are numbered from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_level_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file whose ids follow its merges, else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not plain or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        return None
    back = byte_of_char()
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    if any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    return ranks


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def slices(texts: pa.Array, most: int = _AT_ONCE) -> Iterator[pa.Array]:
    """texts in order, in runs of about `most` bytes; a longer text is a run of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def gathered(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of the pieces in this order, and where each begins and, last, ends; piece i is
    ids[starts[i] : starts[i] + lengths[i]]."""
    at = np.concatenate(([0], np.cumsum(lengths[order], dtype=np.int64)))
    out = np.empty(at[-1], dtype="<u4")
    step = 1 << 19
    for i in range(0, len(order), step):
        o = order[i : i + step]
        from_ = np.repeat(starts[o] - (at[i : i + len(o)] - at[i]).astype(np.int32), lengths[o])
        out[at[i] : at[i + len(o)]] = ids[from_ + np.arange(len(from_), dtype=np.int32)]
    return out, at


class ByteBpe:
    """A byte-level BPE vocabulary; added tokens inside texts keep their own ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, added: dict[str, int], library: Callable[[str], list[int]] | None) -> None:
        import tiktoken

        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.added, self.library, self.feed = added, library, ranks[b"\n"]
        self.special = "|".join(map(re.escape, added))

    def ordinary(self, text: str) -> np.ndarray:
        """ids of a text in which added tokens don't count."""
        return np.asarray(self.bpe.encode_ordinary(text), dtype="<u4")

    def whole(self, text: str) -> np.ndarray:
        try:
            ids = self.bpe.encode(text, allowed_special="all", disallowed_special=()) if self.added else self.bpe.encode_ordinary(text)
        except BaseException as error:  # its regex engine gives up on extreme runs of white space
            if isinstance(error, (KeyboardInterrupt, SystemExit, GeneratorExit)) or self.library is None:
                raise
            ids = self.library(text)
        return np.asarray(ids, dtype="<u4")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids begin and, last, end)."""
        texts = pc.fill_null(texts, "")
        slow = pc.or_(pc.match_substring_regex(texts, _UNEVEN), pc.equal(texts, ""))
        if self.special:
            slow = pc.or_(slow, pc.match_substring_regex(texts, self.special))
        slow = slow.to_numpy(zero_copy_only=False)
        if slow.all():
            parts = [self.whole(t) for t in texts.to_pylist()]
            return np.concatenate([np.empty(0, "<u4"), *parts]), np.cumsum([0, *map(len, parts)])
        ids, bounds = self._even(texts.filter(pa.array(~slow)))
        if not slow.any():
            return ids, bounds
        parts, easy = [], 0
        for hard, text in zip(slow.tolist(), texts):
            if hard:
                parts.append(self.whole(text.as_py()))
            else:
                parts.append(ids[bounds[easy] : bounds[easy + 1]])
                easy += 1
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts that begin and end with a word and have no two white spaces in a row."""
        marked = pc.replace_substring(pc.binary_join_element_wise("\n", texts, ""), "\n", " \n")
        cut = pc.split_pattern(pc.utf8_slice_codeunits(marked, 1), " ")
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        fed = np.fromiter((w[0] == "\n" for w in words), dtype=bool, count=len(words))
        ids = self.ordinary("".join([w if w[0] == "\n" else "\n " + w for w in words]))
        ends = np.flatnonzero(ids == self.feed)
        if len(ends) != len(words):
            raise AssertionError("a line feed joined its neighbours")
        starts = (ends + ~fed).astype(np.int32)
        lengths = np.append(ends[1:], len(ids)).astype(np.int32) - starts
        out, at = gathered(ids, starts, lengths, coded.indices.to_numpy())
        bounds = at[np.asarray(cut.offsets)]
        keep = np.ones(len(out), dtype=bool)
        keep[bounds[:-1]] = False  # the line feed put before each text
        return out[keep], bounds - np.arange(len(bounds))


class WholeTexts:
    """Any other file: the library encodes whole texts."""

    def __init__(self, ids_of_batch: Callable[[list[str]], list[list[int]]]) -> None:
        self.ids_of_batch = ids_of_batch

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for at in range(0, len(texts), 64):
            some = pc.fill_null(texts.slice(at, 64), "").to_pylist()
            parts += [np.asarray(ids, dtype="<u4") for ids in self.ids_of_batch(some)]
        return np.concatenate([np.empty(0, "<u4"), *parts]), np.cumsum([0, *map(len, parts)])


@lru_cache(maxsize=4)
def encoder(path: str) -> ByteBpe | WholeTexts:
    """The encoder of a .json (tokenizers), .tiktoken or .model (sentencepiece) file: no begin or
    end tokens; strings of special tokens inside texts as each library treats them by default."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return WholeTexts(lambda texts: model.encode(texts, num_threads=1))
    import public_tokenizers

    if path.endswith(".tiktoken"):
        return ByteBpe(rank_file(path), public_tokenizers.PATTERN, {}, None)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = byte_level_ranks(spec)
    if ranks is None:
        return WholeTexts(lambda texts: [e.ids for e in _library(path).encode_batch(texts, add_special_tokens=False)])
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return ByteBpe(ranks, public_tokenizers.PATTERN, added, lambda text: _library(path).encode(text, add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def _library(path: str) -> object:
    """The library's own tokenizer, opened when a text first needs it: byte-level files seldom do."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library
