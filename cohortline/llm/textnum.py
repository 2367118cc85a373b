"""Texts as numpy arrays: code points, word hashes and word shingles of whole
batches at a time.

A word is a maximal run of letters, digits or combining marks after
``str.lower``; every hash is a fixed 64-bit polynomial, equal on every machine.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
BLOCK_CHARS = 1 << 19


def blocks(texts: list[str], budget: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``budget`` characters (a longer text stands alone)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > budget:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    for i in range(0x20000):
        c = chr(i)
        out[i] = c.isalnum() or unicodedata.combining(c) > 0
    out[0x20000:0x30000] = True   # further ideographs
    return out


@lru_cache(maxsize=8)
def powers(n: int, base: int = _BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out)


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    size = 64
    while size < n:
        size *= 2
    return powers(size, base)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (so that every output bit depends on all of them)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one uint32 array, a 0 after each; and the start of each text."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    raw = ("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass") if texts else b""
    return np.frombuffer(raw, np.uint32), starts


class Words:
    """Word hashes of a block of texts: ``hash[i]`` belongs to text ``doc[i]``;
    text ``d`` owns words ``first[d]:first[d + 1]``."""

    def __init__(self, texts: list[str], prefix: int = 0):
        cp, starts = codepoints([t.lower() for t in texts])
        is_word = _word_chars()[cp]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], is_word)).astype(np.int8)))
        begin, end = edge[0::2], edge[1::2]
        if len(end) < len(begin):
            end = np.append(end, len(cp))
        self.begin, self.end = begin, end
        if len(begin):
            at = np.flatnonzero(is_word)
            length = end - begin
            word_at = np.repeat(np.arange(len(begin)), length)
            pos = at - begin[word_at]
            pw = _powers(int(length.max()) + 1)
            with np.errstate(over="ignore"):
                terms = (cp[at].astype(np.uint64) + np.uint64(1)) * pw[pos]
                offsets = np.concatenate(([0], np.cumsum(length)[:-1]))
                self.hash = mix(np.add.reduceat(terms, offsets))
                if prefix:
                    terms[pos >= prefix] = 0
                    self.prefix = mix(np.add.reduceat(terms, offsets) + np.uint64(7))
        else:
            self.hash = np.zeros(0, np.uint64)
            self.prefix = self.hash
        self.doc = np.searchsorted(starts, begin, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and the text each belongs to.  A text of
    fewer words (but one at least) has one shingle: all its words."""
    h, n = words.hash, len(words.hash)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pw = powers(k + 1, 0xD6E8FEB86659FD93)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total[: n - j] += h[j:] * pw[j + 1] if j < n else 0
    left = words.first[words.doc + 1] - np.arange(n)      # words from here to the text's end
    keep = left >= k
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        # only words of the text itself may enter a short text's shingle
        for d in short:
            a, b = words.first[d], words.first[d + 1]
            with np.errstate(over="ignore"):
                total[a] = (h[a:b] * pw[1: b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
            keep[a] = True
    at = np.flatnonzero(keep)
    return mix(total[at]), words.doc[at]


def sequence_keys(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's whole word sequence (0 without words)."""
    n_docs = len(words.first) - 1
    out = []
    for base, salt in ((0xA24BAED4963EE407, 1), (0x9FB21C651E98DF25, 2)):
        key = np.zeros(n_docs, np.uint64)
        if len(words.hash):
            pos = np.arange(len(words.hash)) - words.first[words.doc]
            with np.errstate(over="ignore"):
                terms = mix(words.hash + np.uint64(salt)) * _powers(int(pos.max()) + 1, base)[pos]
            has = np.flatnonzero(words.count > 0)
            key[has] = mix(np.add.reduceat(terms, words.first[has]) + words.count[has].astype(np.uint64))
        out.append(key)
    return out[0], out[1]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
