"""SentencePiece encoding and decoding with N-best segmentations.

The piece lattice of a text has an edge for every vocabulary piece that matches
(and one, made of byte pieces, for a character without a piece).  A forward
Viterbi pass gives the best score from the start to every position; searched
backward from the end, those scores are the exact rest costs, so A* yields whole
segmentations in order of score.

No piece goes on past the blank marker that starts a word, so a text's lattice
is a chain of words' lattices: words are searched by themselves (frequent ones are
remembered), and the N best of a text are the best sums over its words.  Only
the ``N - 1`` words with the smallest loss can differ from their best in one of
them; A* over those is exact.

Defined results.  Null and empty texts have no pieces, score 0 and decode to the
empty text.  The marker character itself (U+2581) in a text decodes as a blank, as
in the library; ``round_trip`` is then false.  Scores within ``TIE`` are ties; they go to the segmentation
whose last pieces are longest.  Repeated rows give repeated rows, an empty table an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import threading
import zlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortline.llm.tables import doc_text
from cohortline.llm.textnum import blocks

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
MARK = "▁"
SIGNS = ".,;:!?|%&*$#()"      # signs that often end a word
UNKNOWN_PENALTY = 10.0     # below the worst piece, as the library scores unknown characters
CACHE_WORDS = 100_000      # in each of two halves: about 80 MB a worker while it segments
LEARN_CHARS = 1 << 19      # characters of texts whose unknown words are worked on together
LEARN_WORDS = 1 << 13      # of them at a time
NBEST_WORDS = 8_000        # words whose N best are remembered: the least losses of texts are often those of the same words
IDLE_S = 3.0               # seconds after which a worker that segments no more forgets its words
SHORT_WORD = 32            # longer words' N best are not remembered
LONG_WORD = 1024           # longer words keep no edges
TIE = 1e-6                 # scores nearer than this count as equal in the search
_IDS, _SCORE, _LOSS, _GIVES = map(itemgetter, range(4))      # of a word's entry


def load_vocabulary(model: str = MODEL) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 plain, 1 byte, 2 neither) by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.vocab_size())
    kind = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else 0 for i in ids]
    return [sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], kind


def _node_table(pieces: dict[str, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trie of pieces as arrays: sorted keys ``parent << 21 | character`` (a node is its key's place + 1, the root 0),
    and each node's piece (-1 for none) and score."""
    prefixes = {p[:k] for p in pieces for k in range(1, len(p) + 1)}
    node, keys = {"": 0}, []
    # parents are numbered before their children and by their own order, so keys come in sorted order
    by_length: dict[int, list[str]] = {}
    for p in prefixes:
        by_length.setdefault(len(p), []).append(p)
    for level in sorted(by_length):
        for key, p in sorted((node[p[:-1]] << 21 | ord(p[-1]), p) for p in by_length[level]):
            keys.append(key)
            node[p] = len(keys)
    ids, scores = np.full(len(keys) + 1, -1, np.int64), np.zeros(len(keys) + 1)
    for p, (i, score) in pieces.items():
        ids[node[p]], scores[node[p]] = i, score
    return np.array(keys, np.int64), ids, scores


def _groups(place: np.ndarray) -> list[np.ndarray]:
    """The indexes of each place's members, places ascending."""
    order = np.argsort(place, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []


class Segmenter:
    """N-best segmentation over one vocabulary."""

    def __init__(self, vocabulary: tuple[list[str], list[float], list[int]], nbest: int = NBEST):
        pieces, scores, kinds = vocabulary
        self.n = nbest
        self.piece = {p: (i, s) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds)) if k == 0}
        self.longest = max(map(len, self.piece), default=1)
        self.table = _node_table(self.piece)
        self.byte_id = {int(p[3:-1], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.trie: dict = {}                     # character -> [the next characters' trie, the piece that ends here]
        for p, (i, score) in self.piece.items():
            node = [self.trie, None]
            for c in p:
                node = node[0].setdefault(c, [{}, None])
            node[1] = ((i,), score)
        self.unknown = min((s for _, s in self.piece.values() if s > -1e8), default=0.0) - UNKNOWN_PENALTY
        inner = any(MARK in p.lstrip(MARK) for p in self.piece)
        if inner:
            raise ValueError("a piece goes on past a blank; its texts can't be cut at words")
        # white space of which no longer piece is made also ends a lattice
        plain = [c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in self.piece)]
        breaks = "".join(re.escape(c) for c in plain)
        # so does a letter before a sign that no piece has after a letter
        follows = {b for p in self.piece for a, b in zip(p, p[1:]) if a.isalpha()}
        signs = "".join(re.escape(c) for c in SIGNS if c not in follows)
        rest = f"[^{MARK}{breaks}]"
        # letters are never given back (no sign is a letter); a run of plain ones is matched quickly
        letters = f"(?:[A-Za-z]++[^\\W\\d_]*+|[^\\W\\d_]++)(?:(?=[{signs}])|{rest}*)|" if signs else ""
        self.words = re.compile(f"{MARK}+(?:{letters}{rest}*)" + (f"|[{breaks}]" if breaks else "") + f"|{letters}{rest}+")
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if k == 1 else b"" if k == 2 else p.replace(MARK, " ").encode()
                         for p, k in zip(pieces, kinds)]
        self.cache: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}
        self.choices: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self.lossy = False         # whether any word met so far had ids that don't decode to it

    # ── one word ─────────────────────────────────────────────────────────────

    def lattice(self, word: str) -> list[tuple[int, int, tuple[int, ...], float]]:
        """Edges ``(start, end, ids, score)``, by start."""
        return [(i, j, ids, s) for i in range(len(word)) for j, ids, s in self.edges_from(word, i)]

    def edges_from(self, word: str, i: int) -> list[tuple[int, tuple[int, ...], float]]:
        """``(end, ids, score)`` of the pieces that start at ``i``."""
        node, j, out = self.trie, i, []
        while j < len(word) and (found := node.get(word[j])):
            node, piece = found
            j += 1
            if piece is not None:
                out.append((j, *piece))
        if not out or out[0][0] != i + 1:
            out.insert(0, (i + 1, *self.unknown_piece(word[i])))
        return out

    def edges_into(self, word: str, j: int) -> list[tuple[int, tuple[int, ...], float]]:
        """``(start, ids, score)`` of the pieces that end at ``j``, longest first."""
        out = []
        for i in range(max(0, j - self.longest), j):
            piece = self.piece.get(word[i:j])
            if piece is not None:
                out.append((i, (piece[0],), piece[1]))
        if not out or out[-1][0] != j - 1:
            out.append((j - 1, *self.unknown_piece(word[j - 1])))
        return out

    def unknown_piece(self, c: str) -> tuple[tuple[int, ...], float]:
        return tuple(self.byte_id.get(b, 0) for b in c.encode("utf-8", "surrogatepass")), self.unknown

    def viterbi(self, word: str) -> list[float]:
        """Forward scores: the best sum of pieces up to every place."""
        best = [0.0] + [float("-inf")] * len(word)
        for i in range(len(word)):
            here = best[i]
            for j, _, s in self.edges_from(word, i):
                if here + s > best[j]:
                    best[j] = here + s
        return best

    def nbest(self, word: str, n: int | None = None) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best segmentations of a word, best first: backward A* from the word's end, the
        forward Viterbi scores as exact estimates of what is left.

        Among paths of equal score (to ``TIE``) the one nearest the word's start goes on, so a
        word with any number of equally good paths takes about one path's steps per result; last
        pieces are then longest first.  Edges are looked up where the search comes by."""
        n = n or self.n
        best = self.viterbi(word)
        out, serial = [], 0
        heap = [(-round(best[-1] / TIE), len(word), 0, 0.0, None)]
        while heap and len(out) < n:
            _, at, _, score, tail = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                out.append((score, tuple(ids)))
                continue
            for i, ids, s in self.edges_into(word, at):
                serial += 1
                heapq.heappush(heap, (-round((best[i] + s + score) / TIE), i, serial, score + s, (ids, tail)))
        return out

    def _long_word(self, word: str) -> tuple[bytes, float, float, bool]:
        """As ``_word``, in memory of one number per character: edges are walked twice, not kept."""
        n, low = len(word), float("-inf")
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        for i in range(n):
            here = best[i]
            for j, ids, s in self.edges_from(word, i):
                if here + s > best[j]:
                    best[j], back[j] = here + s, (i, ids)
        ids, at, follow = [], n, {}
        while at:
            i, piece = back[at]
            ids.append(piece)
            follow[i] = at
            at = i
        rest, second = [low] * n + [0.0], low
        for i in range(n - 1, -1, -1):
            for j, _, s in self.edges_from(word, i):
                r = s + rest[j]
                rest[i] = max(rest[i], r)
                if follow.get(i) != j and best[i] + r > second:
                    second = best[i] + r
        whole = [x for piece in reversed(ids) for x in piece]
        return np.array(whole, np.int32).tobytes(), best[n], max(0.0, best[n] - second), self.gives(whole, word)

    def gives(self, ids: list[int], word: str) -> bool:
        """Whether the ids decode to the word."""
        of = self.bytes_of
        same = b"".join([of[i] for i in ids]) == word.replace(MARK, " ").encode("utf-8", "surrogatepass")
        self.lossy = self.lossy or not same
        return same

    def _word(self, word: str) -> tuple[bytes, float, float, bool]:
        """Best ids (as bytes), best score, whether they decode to the word, and what the second best loses: the best
        path over any edge off the best path, by forward and backward scores."""
        n = len(word)
        if n > LONG_WORD:
            return self._long_word(word)         # not remembered: such words hardly come again
        low = float("-inf")
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        edges = []
        trie, add = self.trie, edges.append
        for i in range(n):                       # lattice and forward Viterbi in one walk
            node, j, here, single = trie, i, best[i], False
            while j < n and (found := node.get(word[j])):
                node, piece = found
                j += 1
                if piece is not None:
                    if j == i + 1:
                        single = True
                    ids, s = piece
                    v = here + s
                    e = (i, j, v, s, ids)
                    add(e)
                    if v > best[j]:
                        best[j] = v
                        back[j] = e
            if not single:
                ids, s = self.unknown_piece(word[i])
                e = (i, i + 1, here + s, s, ids)
                add(e)
                if e[2] > best[i + 1]:
                    best[i + 1] = e[2]
                    back[i + 1] = e
        path, at = [], n
        while at:
            e = back[at]
            path.append(e)
            at = e[0]
        on = set(map(id, path))
        rest = [low] * n + [0.0]
        second = low
        for e in reversed(edges):
            i, j, v, s, _ = e
            r = rest[j]
            if r + s > rest[i]:
                rest[i] = r + s
            if v + r > second and id(e) not in on:
                second = v + r
        ids = [x for e in reversed(path) for x in e[4]]
        entry = (array("i", ids).tobytes(), best[n], max(0.0, best[n] - second), self.gives(ids, word))
        self._remember(word, entry)
        return entry

    def _remember(self, word: str, entry: tuple) -> None:
        if len(self.cache) >= CACHE_WORDS:
            self.older = self.cache              # words met again come back from the older half
            self.cache = {}
        self.cache[word] = entry

    def learn(self, words: Iterable[str]) -> None:
        """Remember the entries (see ``_word``) of words, all those that are not known worked on together."""
        new = []
        for w in words:
            if w not in self.cache:
                entry = self.older.pop(w, None)
                if entry is not None:
                    self._remember(w, entry)
                elif len(w) <= SHORT_WORD:
                    new.append(w)
        for lo in range(0, len(new), LEARN_WORDS):
            some = new[lo:lo + LEARN_WORDS]
            for w, entry in zip(some, self._words(some)):
                if entry is not None:            # else left to _word
                    self._remember(w, entry)

    def _words(self, words: list[str]) -> list[tuple | None]:
        """``_word`` of many short words, with the same sums in the same order; None for words with a character
        without a piece.  The words' characters stand in one array, place ``length + 1`` of each being its end."""
        keys, node_id, node_score = self.table
        length = np.fromiter(map(len, words), np.int64, len(words))
        first = np.concatenate(([0], np.cumsum(length + 1)))
        chars = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        last = first[1:] - 1
        of = np.repeat(np.arange(len(words)), length + 1)
        offset = np.arange(first[-1]) - first[of]
        # edges: pieces from every place, one character longer at a time
        start = np.flatnonzero(offset < length[of])
        node, edges, plain = np.zeros(len(start), np.int64), [], np.ones(len(words), bool)
        for k in range(self.longest):
            key = (node << 21) | chars[start + k]
            at = np.searchsorted(keys, key)
            at[at == len(keys)] = 0
            go = keys[at] == key
            if not k:
                plain[of[start[~go]]] = False
            start, node = start[go], at[go] + 1
            hit = node_id[node] >= 0
            if not k:
                plain[of[start[~hit]]] = False
            edges.append((start[hit], start[hit] + k + 1, node[hit]))
            inside = start + k + 1 < last[of[start]]
            start, node = start[inside], node[inside]
            if not len(start):
                break
        begin, end, node = (np.concatenate(x) for x in zip(*edges))
        kept = plain[of[begin]]
        begin, end, node = begin[kept], end[kept], node[kept]
        score = node_score[node]
        low = float("-inf")
        # forward, by the place of the begin (ends differ there): the first of equal paths stays
        best, back = np.full(first[-1], low), np.zeros(first[-1], np.int64)
        best[first[:-1]] = 0.0
        value = np.empty(len(begin))
        for e in _groups(offset[begin]):
            value[e] = v = best[begin[e]] + score[e]
            e, v = (x[v > best[end[e]]] for x in (e, v))
            best[end[e]], back[end[e]] = v, e
        # backward, by the place of the end (begins differ there)
        rest = np.full(first[-1], low)
        rest[last] = 0.0
        for e in reversed(_groups(offset[end])):
            rest[begin[e]] = np.maximum(rest[begin[e]], rest[end[e]] + score[e])
        on = np.zeros(len(begin), bool)
        at = last[plain]
        while len(at):
            on[back[at]] = True
            at = begin[back[at]]
            at = at[offset[at] > 0]
        total = value + rest[end]
        total[on] = low
        second = np.full(len(words), low)
        np.maximum.at(second, of[begin], total)
        path = np.flatnonzero(on)
        path = path[np.argsort(begin[path])]
        raw = node_id[node[path]].astype(np.int32).tobytes()
        cut = 4 * np.concatenate(([0], np.cumsum(np.bincount(of[begin[path]], minlength=len(words)))))
        top = best[last]
        with np.errstate(invalid="ignore"):
            loss = np.maximum(0.0, top - second)
        return [(raw[a:b], t, x, True) if ok else None
                for a, b, t, x, ok in zip(cut[:-1].tolist(), cut[1:].tolist(), top.tolist(), loss.tolist(), plain.tolist())]

    def _entries(self, units: list[str]) -> list[tuple]:
        get, miss = self.cache.get, self._miss
        return [get(u) or miss(u) for u in units]

    def _miss(self, word: str) -> tuple:
        entry = self.cache.get(word)             # the cache may have been turned over meanwhile
        if entry is None:
            entry = self.older.pop(word, None)
            if entry is not None:
                self._remember(word, entry)
        return entry or self._word(word)

    # ── whole texts ──────────────────────────────────────────────────────────

    def units(self, text: str) -> list[str]:
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str) -> tuple[np.ndarray, list[float]]:
        """Ids of the best segmentation and the scores of the N best."""
        raw, ranked, _ = self.ranked(text)
        return np.frombuffer(raw, np.int32), [score for score, _ in ranked]

    def segmentations(self, text: str) -> list[tuple[float, list[int]]]:
        """The N best segmentations of a text: ``(score, ids)``."""
        raw, ranked, _ = self.ranked(text)
        best = np.frombuffer(raw, np.int32).tolist()
        return [(score, with_edits(best, edits)) for score, edits in ranked]

    def ranked(self, text: str) -> tuple[bytes, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]], bool]:
        """The best ids as bytes; the N best segmentations by score, each as edits of the best ids ``(at, drop,
        ids)``: at place ``at``, ``drop`` ids give way to others; and whether the best ids decode to the text: its
        words' ids do, and its words are the text."""
        return self._ranked(text, self.units(text))

    def ranked_all(self, texts: list[str]) -> Iterator[tuple[bytes, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]], bool]]:
        """``ranked`` of every text; unknown words of about ``LEARN_CHARS`` characters of texts are worked on together."""
        for lo, hi in blocks(texts, LEARN_CHARS):
            units = [self.units(t) for t in texts[lo:hi]]
            self.learn(set().union(*units))
            for text, words in zip(texts[lo:hi], units):
                yield self._ranked(text, words)

    def _ranked(self, text: str, units: list[str]) -> tuple[bytes, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]], bool]:
        if not units:
            return b"", [(0.0, [])], not text
        entries = self._entries(units)
        raw = list(map(_IDS, entries))
        total = float(sum(map(_SCORE, entries)))
        out, before = [], None
        for x, swaps in self._least(units, np.fromiter(map(_LOSS, entries), np.float64, len(entries))):
            if swaps and before is None:
                before = list(accumulate(map(len, raw), initial=0))
            out.append((total - x, [(before[k] // 4, len(raw[k]) // 4, swaps[k]) for k in sorted(swaps)] if swaps else []))
        same = MARK not in text and (not self.lossy or all(map(_GIVES, entries)))
        return b"".join(raw), out, same

    def _choices(self, word: str) -> list[tuple[float, tuple[int, ...]]]:
        """``nbest`` of a word, remembered if it is not long."""
        got = self.choices.get(word)
        if got is None:
            got = self.nbest(word)
            if len(word) <= SHORT_WORD:
                if len(self.choices) >= NBEST_WORDS:
                    self.choices = {}
                self.choices[word] = got
        return got

    def _least(self, units: list[str], loss: np.ndarray) -> list[tuple[float, dict[int, tuple[int, ...]]]]:
        """The N least losses over all words' choices, with the words not at their best; ``loss``: of each word's second best."""
        n = self.n
        if len(loss) > n - 1 > 0:                # ties go to the words that come first
            few = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2])
            few = few[np.argsort(loss[few], kind="stable")[:n - 1]]
        else:
            few = np.arange(len(loss) if n > 1 else 0)
        few = few[np.isfinite(loss[few])]
        choices = [self._choices(units[w]) for w in few]
        heap, out, serial = [(0.0, 0, 0, ())], [], 0
        while heap and len(out) < n:
            x, _, k, swaps = heapq.heappop(heap)
            if k == len(few):
                out.append((x, dict(swaps)))
                continue
            top = choices[k][0][0]
            for r, (score, ids) in enumerate(choices[k]):
                serial += 1
                heapq.heappush(heap, (x + top - score, serial, k + 1, swaps + ((int(few[k]), ids),) if r else swaps))
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8, the first blank dropped."""
        of = self.bytes_of
        text = b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def with_edits(best: list[int], edits: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
    """The ids of a segmentation that differs from the best ids by ``edits`` (in order of their places)."""
    out, done = [], 0
    for at, drop, ids in edits:
        out += best[done:at]
        out += ids
        done = at + drop
    return out + best[done:]


_EDIT = pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])
_NBEST = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(_EDIT))]))
_COLUMNS = {"doc_id": ("bigint", pa.int64()), "ids": ("array<int>", pa.list_(pa.int32())), "n_pieces": ("bigint", pa.int64()),
            "score": ("double", pa.float64()), "nbest_scores": ("array<double>", pa.list_(pa.float64())), "ids_crc": ("bigint", pa.int64()),
            "round_trip": ("boolean", pa.bool_()), "nbest": ("array<struct<score:double,edits:array<struct<at:int,drop:int,ids:array<int>>>>>", _NBEST)}
_SEGMENTERS: dict[tuple, Segmenter] = {}


_RESTING: list[threading.Timer] = []


@contextmanager
def _segmenter(shared, model: str, nbest: int) -> Iterator[Segmenter]:
    """One segmenter (and its remembered words) per Python worker, kept from task to task.  Spark keeps idle workers and
    gives them other operators' tasks: words are forgotten once no task has asked for them for ``IDLE_S``."""
    while _RESTING:
        _RESTING.pop().cancel()
    sp = _SEGMENTERS.get((model, nbest)) or Segmenter(shared.value, nbest)
    _SEGMENTERS[model, nbest] = sp
    try:
        yield sp
    finally:
        rest = threading.Timer(IDLE_S, _SEGMENTERS.clear)
        rest.daemon = True
        _RESTING.append(rest)
        rest.start()


def encode(docs: DataFrame, model: str = MODEL, nbest: int = NBEST, segmentations: bool = False) -> DataFrame:
    """``doc_id, ids, n_pieces, score, nbest_scores, ids_crc, round_trip`` of every document, and with
    ``segmentations`` also ``nbest``: for each of the ``nbest`` best segmentations its score and where its ids
    differ from ``ids`` (at place ``at``, ``drop`` ids give way to others; none for the best).

    ``round_trip`` says whether decoding the ids gives the very text back."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))    # the vocabulary: under 1 MB
    names = [c for c in _COLUMNS if segmentations or c != "nbest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _segmenter(shared, model, nbest) as sp:
            for batch in batches:
                # results go on in pieces: a batch's ids are as many as its characters at worst
                rows, size = [], 0
                for doc_id, ranked in zip(batch.column("doc_id").to_pylist(), sp.ranked_all(batch.column("text").to_pylist())):
                    rows.append((doc_id, *ranked))
                    size += len(rows[-1][1])
                    if size > 8_000_000:
                        yield _batch(rows, names)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows, names)

    return doc_text(docs).mapInArrow(run, ", ".join(f"{c} {_COLUMNS[c][0]}" for c in names))


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    doc_ids, best, ranked, same = zip(*rows)
    scores = [[s for s, _ in r] for r in ranked]
    sizes = [len(x) // 4 for x in best]
    columns = {"doc_id": doc_ids, "n_pieces": sizes, "score": [s[0] for s in scores], "nbest_scores": scores,
               "ids_crc": [zlib.crc32(x) for x in best], "round_trip": same}
    if "nbest" in names:
        columns["nbest"] = [[{"score": s, "edits": [{"at": a, "drop": d, "ids": i} for a, d, i in edits]} for s, edits in r] for r in ranked]
    out = {c: pa.array(v, _COLUMNS[c][1]) for c, v in columns.items()}
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    out["ids"] = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(best), np.int32)))
    return pa.RecordBatch.from_arrays([out[c] for c in names], names=names)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``doc_id, text`` of rows with ``doc_id`` and ``ids``."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _segmenter(shared, model, NBEST) as sp:
            for batch in batches:
                texts = [sp.decode(x or []) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def nbest_segmentations(docs: DataFrame, model: str = MODEL, nbest: int = NBEST) -> DataFrame:
    """``doc_id, place, score, ids`` of the ``nbest`` best segmentations of every document, ids in full."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _segmenter(shared, model, nbest) as sp:
            for batch in batches:
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                    got = sp.segmentations(text)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_id] * len(got), pa.int64()), pa.array(range(1, len(got) + 1), pa.int32()),
                         pa.array([s for s, _ in got], pa.float64()), pa.array([i for _, i in got], pa.list_(pa.int32()))],
                        names=["doc_id", "place", "score", "ids"])

    return doc_text(docs).mapInArrow(run, "doc_id bigint, place int, score double, ids array<int>")
