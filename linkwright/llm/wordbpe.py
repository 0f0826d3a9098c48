"""Byte-pair encoding through a table of distinct words.

The vocabulary drops white space and never merges across it, so a text's ids are the ids of its white-space separated
words one after another.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np

VOCABULARY = "word_bpe_49k.json"
_ODD = re.compile("[\x1c-\x1f]")  # str.split() splits there, the vocabulary's pattern does not
_CALL = 512  # words given to the library at a time


def split_words(text: str) -> list[str]:
    return text.split() if not _ODD.search(text) else [w.decode() for w in text.encode().split()]


def load(vocabulary: str):
    """The tokenizer from a path, or by a name that public_tokenizers knows; found on each executor by itself."""
    from tokenizers import Tokenizer

    if "/" not in vocabulary:
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    tokenizer = Tokenizer.from_file(vocabulary)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_words(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, flat, and how many each has. One call encodes many; a token's offset tells its word."""
    flat, counts = [], []
    for lo in range(0, len(words), _CALL):
        part = words[lo : lo + _CALL]
        got = tokenizer.encode(" ".join(part), add_special_tokens=False)
        begins = np.cumsum([0] + [len(w) + 1 for w in part])
        at = np.fromiter((x for x, _ in got.offsets), np.int64, len(got))
        flat.append(np.array(got.ids, np.int32))
        counts.append(np.bincount(np.searchsorted(begins, at, "right") - 1, minlength=len(part)))
    return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class _Index(dict):
    """Word to row; a word it lacks gets the next row and waits in `new` for its ids."""

    def __init__(self, words=()):
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        row = self[word] = len(self)
        self.new.append(word)
        return row


class WordTable:
    """Distinct words met so far and their ids. Past `limit` words those that few portions used go, so memory is bounded."""

    def __init__(self, vocabulary: str = VOCABULARY, limit: int = 500_000):
        self.tokenizer, self.limit = load(vocabulary), limit
        self._start([], np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _start(self, words: list[str], flat: np.ndarray, counts: np.ndarray):
        self.index, self.flat, self.used = _Index(words), flat, len(flat)
        self.counts, self.starts = counts, np.cumsum(counts) - counts
        self.hits = np.ones(len(counts), np.int32)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, len(a) * 3 // 2, 1 << 14), a.dtype)
        out[: len(a)] = a
        return out

    def _thin(self, room: int) -> None:
        n = len(self.index)
        for least in (2, 4, 16):
            kept = np.flatnonzero(self.hits[:n] >= least)
            if len(kept) <= room:
                break
        else:
            kept = kept[:0]
        counts = self.counts[kept]
        flat = self.flat[np.repeat(self.starts[kept] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
        words = list(self.index)
        self._start([words[i] for i in kept.tolist()], flat, counts)

    def _fill(self) -> None:
        """Ids for the words that wait."""
        new, self.index.new = self.index.new, []
        if not new:
            return
        flat, counts = encode_words(self.tokenizer, new)
        m, size = len(new), len(self.index)
        self.flat = self._room(self.flat, self.used + len(flat))
        self.starts, self.counts, self.hits = (self._room(a, size) for a in (self.starts, self.counts, self.hits))
        self.flat[self.used : self.used + len(flat)] = flat
        self.starts[size - m : size] = self.used + np.cumsum(counts) - counts
        self.counts[size - m : size] = counts
        self.hits[size - m : size] = 0
        self.used += len(flat)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [split_words(t) for t in texts]
        if len(self.index) > self.limit:
            self._thin(self.limit // 2)
        sizes = np.array([len(w) for w in split], np.int64)
        get = self.index.__getitem__
        k = np.fromiter(map(get, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        self._fill()
        seen = np.bincount(k, minlength=len(self.index)) > 0
        self.hits[: len(seen)] += seen
        counts = self.counts[k]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.starts[k] - (ends - counts), counts) + np.arange(total)]
        at = np.concatenate([[0], ends])[np.cumsum(sizes)]
        return np.split(ids, at[:-1]) if len(at) else []


_tables: dict[str, WordTable] = {}


def shared_table(vocabulary: str = VOCABULARY) -> WordTable:
    """This Python worker's table; it serves all tasks that the worker runs."""
    if vocabulary not in _tables:
        _tables[vocabulary] = WordTable(vocabulary)
    return _tables[vocabulary]


def in_portions(texts: list[str], limit: int = 2_000_000):
    """(first, texts) portions of at most `limit` characters, or one longer text."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, texts[lo:]
