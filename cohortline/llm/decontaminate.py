"""Benchmark decontamination by the q-gram lemma and banded alignment.

An approximate copy of an item of ``m`` characters with at most ``e`` edits
shares at least ``m + 1 - q * (e + 1)`` of its q-grams with the item, on
diagonals at most ``e`` apart.  Every text position whose q-gram occurs in an
item counts for the item's diagonal bands (width ``2 (e + 1)``, overlapping by
half); bands that reach the bound are aligned in their band only, and a region is
a leak when it needs no more than ``e`` edits.  Both sides are compared lower-cased
with white space runs as one space; spans are offsets in the text as given.

The benchmark is the stated query set.  It is read in blocks of at most
``BLOCK_BYTES`` of text (a broadcast of a proven bound), one of which the driver holds at
a time; each block is a step of its own over all documents, so any number of items is
searched.  A text's matches are worked on in slices of bounded size.

Defined results.  Null or empty texts have no leak, null or empty items are never
found; items shorter than ``Q`` characters are found by exact search.  Repeated rows give
repeated rows, repeated items are found under each id; empty tables give an empty
result or no leaks.  Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.tables import doc_text
from cohortline.llm.textnum import blocks, codepoints

Q = 8
EDIT_RATE = 0.10
BLOCK_BYTES = 4 << 20
MATCHES = 1 << 20        # q-gram matches held at a time
_TABLE_BITS = 22
_EDIT = 1 << 32          # one edit, above the start offset kept in the low bits


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case of each code point (where it is one code point), white space as a blank."""
    low = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x1F000):
        c = chr(i)
        lc = c.lower()
        if c.isspace():
            low[i] = 32
        elif len(lc) == 1:
            low[i] = ord(lc)
    return low, low == 32


def fold(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points and the place each had in ``cp``."""
    low, _ = _folding()
    out = low[cp]
    blank = out == 32
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    return out[at], at


def fold_text(text: str) -> np.ndarray:
    cp, _ = codepoints([text])
    out, _ = fold(cp[:-1])
    if len(out) and out[0] == 32:
        out = out[1:]
    if len(out) and out[-1] == 32:
        out = out[:-1]
    return out


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the Q = 8 characters from each position (doubling steps)."""
    n = len(c) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    h = (c * np.uint32(0x9E3779B1)) ^ (c >> np.uint32(3))
    base = np.uint32(0x85EBCA6B)
    width = 1
    with np.errstate(over="ignore"):
        while width < Q:
            h = h[:-width] * base + h[width:]
            base = np.uint32((int(base) * int(base)) & 0xFFFFFFFF)
            width *= 2
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
    return h[:n]


def edit_budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed in an item of ``m`` characters: the rate, as far as the lemma's bound stays above 0."""
    return max(0, min(int(rate * m), m // Q - 1))


class BenchIndex:
    """The q-grams of a block of items, ready to be met by texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE):
        self.ids, self.chars, self.short = [], [], []
        for item_id, text in items:
            c = fold_text(text or "")
            if len(c) >= Q:
                self.ids.append(item_id)
                self.chars.append(c)
            elif len(c):
                self.short.append((item_id, c))
        self.length = np.array([len(c) for c in self.chars], np.int64)
        self.budget = np.array([edit_budget(len(c), rate) for c in self.chars], np.int64)
        self.bound = self.length + 1 - Q * (self.budget + 1)
        grams = [gram_hashes(c) for c in self.chars]
        h = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        pos = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.pos = h[order], item[order], pos[order]
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[self.hash >> np.uint32(32 - _TABLE_BITS)] = True

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Leaks of each text: ``(item id, start, end, edits)``."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        for lo, hi in blocks(texts):
            self._search_block(texts[lo:hi], out, lo)
        return out

    def _search_block(self, texts, out, base):
        cp, starts = codepoints(texts)
        c, at = fold(cp)
        first = np.searchsorted(at, starts)                    # each text's first kept character
        ends = np.append(first[1:], len(c)) - 1                # its separator
        for item_id, want in self.short:
            for d, (a, b) in enumerate(zip(first, ends)):
                p = _find(c[a:b], want)
                if p >= 0:
                    s = int(at[a + p] - starts[d])
                    out[base + d].append((item_id, s, int(at[a + p + len(want) - 1] - starts[d]) + 1, 0))
        for d, item, a, b, edits in self._leaks(c, first, ends):
            s = int(at[a] - starts[d])
            out[base + d].append((self.ids[item], s, int(at[b - 1] - starts[d]) + 1, int(edits)))

    def _leaks(self, c, first, ends):
        h = gram_hashes(c)
        hit = np.flatnonzero(self.table[h >> np.uint32(32 - _TABLE_BITS)]) if len(self.hash) else np.zeros(0, np.int64)
        lo = np.searchsorted(self.hash, h[hit], "left")
        n = np.searchsorted(self.hash, h[hit], "right") - lo
        hit, lo, n = hit[n > 0], lo[n > 0], n[n > 0]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for which, b in sorted(self._regions(len(c), hit, lo, n)):
            self._verify(c, first, ends, which, b, found)
        leaks = []
        for (d, which), spans in found.items():
            leaks += [(d, which, *s) for s in _apart(sorted(set(spans), key=lambda s: (s[2], s[0], s[1])))]
        return leaks

    def _regions(self, size: int, hit: np.ndarray, lo: np.ndarray, n: np.ndarray) -> set[tuple[int, int]]:
        """``(item, band)`` of all bands that reach their bound.  Matches are worked on in slices of about
        ``MATCHES`` of them; slices overlap by a band's reach, so each band is whole in one."""
        regions: set[tuple[int, int]] = set()
        if not len(hit):
            return regions
        longest = int(self.length.max())
        reach = longest + 4 * (int(self.budget.max()) + 1) + Q
        before = np.concatenate(([0], np.cumsum(n)))
        n_bands = size + longest + 2
        a = 0
        while a < len(hit):
            z = max(int(np.searchsorted(before, before[a] + MATCHES, "right")) - 1, int(np.searchsorted(hit, hit[a] + 2 * reach)), a + 1)
            z = min(z, len(hit))
            entry = np.repeat(lo[a:z], n[a:z]) + np.arange(before[z] - before[a]) - np.repeat(before[a:z] - before[a], n[a:z])
            item, pos = self.item[entry], self.pos[entry]
            diagonal = np.repeat(hit[a:z], n[a:z]) - pos + longest            # not negative
            band = diagonal // (self.budget[item] + 1)
            key = np.concatenate([item * n_bands + band, item * n_bands + band - 1])
            order = np.lexsort((np.concatenate([pos, pos]), key))
            key, pos = key[order], np.concatenate([pos, pos])[order]
            other = np.concatenate(([True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])))   # different q-grams of the item
            key = key[other]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            enough = np.diff(np.append(cut, len(key))) >= self.bound[key[cut] // n_bands]
            regions.update(divmod(int(k), n_bands) for k in key[cut[enough]])
            if z == len(hit):
                break
            a = max(a + 1, int(np.searchsorted(hit, hit[z - 1] - reach)))
        return regions

    def _verify(self, c, first, ends, which, band, found):
        m, e = int(self.length[which]), int(self.budget[which])
        half = e + 1
        low = band * half - int(self.length.max())             # first diagonal of the band
        lo_all, hi_all = low - e, low + 2 * half + e + m
        # the band may touch several short texts: each is searched by itself
        d0 = max(0, int(np.searchsorted(first, max(lo_all, 0), "right")) - 1)
        d1 = int(np.searchsorted(first, hi_all, "left"))
        for d in range(d0, d1):
            lo, hi = max(lo_all, int(first[d])), min(hi_all, int(ends[d]))
            if hi - lo < m - e:
                continue
            p = _find(c[lo:hi], self.chars[which])
            if p >= 0:
                found.setdefault((d, which), []).append((lo + p, lo + p + m, 0))
                continue
            got = banded_match(self.chars[which], c[lo:hi], lo_all - lo, 2 * half + 2 * e, e) if e else None
            if got:
                found.setdefault((d, which), []).append((lo + got[0], lo + got[1], got[2]))


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order, without those that overlap one taken before (neighbouring bands find a region twice)."""
    taken: list[tuple[int, int, int]] = []
    starts: list[int] = []
    for s in spans:
        k = bisect_left(starts, s[0])
        if (k == 0 or taken[k - 1][1] <= s[0]) and (k == len(taken) or taken[k][0] >= s[1]):
            taken.insert(k, s)
            starts.insert(k, s[0])
    return sorted(taken, key=lambda s: (s[2], s[0], s[1]))


def _find(c: np.ndarray, want: np.ndarray) -> int:
    text, w = c.tobytes(), want.tobytes()
    p = text.find(w)
    while p >= 0 and p % 4:
        p = text.find(w, p + 1)
    return p // 4 if p >= 0 else -1


def banded_match(item: np.ndarray, text: np.ndarray, low: int, width: int, budget: int) -> tuple[int, int, int] | None:
    """Best part of ``text`` within ``budget`` edits of the whole ``item``, along the
    diagonals ``low .. low + width``: ``(start, end, edits)``, or None.

    Cell ``o`` of row ``i`` stands for text position ``i + low + o``; the start rides
    in the low bits of the cost."""
    big = np.int64(1) << 50
    n = len(text)
    o = np.arange(width + 1, dtype=np.int64)
    j = o + low
    cost = np.where((j >= 0) & (j <= n), np.maximum(j, 0), big)
    ramp = o * _EDIT
    padded = np.full(len(item) + width + 2, 0xFFFFFFFF, np.uint32)
    src0, src1 = max(0, low), min(n, low + len(padded))
    if src1 > src0:
        padded[src0 - low:src1 - low] = text[src0:src1]
    limit = (budget + 1) * _EDIT
    for i in range(1, len(item) + 1):
        step = cost + np.where(padded[i - 1:i + width] == item[i - 1], 0, _EDIT)
        step[:-1] = np.minimum(step[:-1], cost[1:] + _EDIT)               # item character left out
        j = o + low + i
        step[(j < 0) | (j > n)] = big
        cost = np.minimum.accumulate(step - ramp) + ramp                  # text characters put in
        cost[(j < 0) | (j > n)] = big
        if cost.min() >= limit:
            return None
    best = int(cost.argmin())
    value = int(cost[best])
    edits, start = value // _EDIT, value % _EDIT
    end = best + low + len(item)
    return (start, end, edits) if edits <= budget and end > start else None


_DDL = ("doc_id bigint, text string, item_ids array<bigint>, starts array<bigint>, "
        "ends array<bigint>, edits array<bigint>")
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string())] +
                   [(n, pa.list_(pa.int64())) for n in ("item_ids", "starts", "ends", "edits")])


def bench_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``block_bytes`` of text, by id; one block is held at a time."""
    items = benchmark.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    held, size = [], 0
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        size += len(r["text"]) * 4
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """Every document with the benchmark items in it: ``doc_id, text, item_ids,
    starts, ends, edits`` (four arrays that belong together, empty if clean)."""
    none = F.array().cast("array<bigint>")
    rows = doc_text(docs).select("doc_id", "text", *[none.alias(n) for n in ("item_ids", "starts", "ends", "edits")])
    sc = docs.sparkSession.sparkContext
    for block in bench_blocks(benchmark):
        index = sc.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            bench = _index(index)
            for b in batches:
                texts = b.column("text").to_pylist()
                new = bench.search(texts)
                cols = [b.column("doc_id"), b.column("text")]
                for k, name in enumerate(("item_ids", "starts", "ends", "edits")):
                    old = b.column(name).to_pylist()
                    cols.append(pa.array([o + [x[k] for x in sorted(n)] for o, n in zip(old, new)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, schema=_ARROW)

        rows = rows.mapInArrow(run, _DDL)
    return rows


def _index(shared) -> BenchIndex:
    block, rate = shared.value
    return BenchIndex(block, rate)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, every column as it was."""
    sc = docs.sparkSession.sparkContext
    for block in bench_blocks(benchmark):
        index = sc.broadcast((block, rate))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            bench = _index(index)
            for b in batches:
                texts = [t or "" for t in b.column(b.schema.names.index("text")).to_pylist()]
                yield b.filter(pa.array([not x for x in bench.search(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
