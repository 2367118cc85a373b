"""Toxicity: a convolutional text classifier trained on every labelled row.

A word is the sum of two hashed embeddings (the word and its first five
letters).  Filters over one, two and three words, ReLU, max pooling over the
whole text and a logistic layer give the score.  The labelled rows outside the held-out
fold are turned into word numbers and written once; no row of them passes through the driver.  Fold 1
calibrates the score (Platt scaling at the labels' true rate) and sets a threshold for each language, on
a grid of ``1 / GRID`` whose counts are of all its rows; the other folds train.

Training runs in ``EPOCHS`` rounds: up to ``TRAINERS`` tasks each go over their share of the rows, beginning with
the round's parameters, and what they changed is averaged, an embedding's change over the tasks that met
its word; between rounds a row of parameters keeps the mean of its Adagrad state.  Documents of a word, and the sums of each step of the scaling, are counted over all rows too.  The driver
holds the parameters (at most 22 MB, and their states) and one row of sums a task.  Scoring reads every whole text.

Defined results.  Null and empty texts, and texts without a word, are scored as
one neutral word.  Without labels of both classes every score is the share of
label 1 (0 if there are none).  Repeated rows give repeated rows; an empty table
an empty result; rows of ``labels`` with a null are ignored.  Languages without
enough calibration rows use the threshold 0.5.  Trained parameters depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.joins import lookup_join
from cohortline.llm.tables import written
from cohortline.llm.textnum import Words, blocks

WORD_SLOTS = 1 << 18
PREFIX_SLOTS = 1 << 16
PREFIX = 5
DIM = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
TRAINERS = 128           # tasks of one round at most
TRAINER_ROWS = 10_000    # rows of a task at least, as far as the files allow
HELD_WORDS = 1 << 21     # words that a task puts in random order at a time
PIECE_WORDS = 1 << 16    # words whose filter outputs are held at a time
GRID = 1 << 16           # steps of a threshold
EPOCHS = 5
BATCH = 32
MIN_TEXTS = 3
FOLD = 5                 # rows whose crc32(id) mod 5 is 0 are held out
MIN_LANG_ROWS = 30


def word_ids(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word slots, prefix slots and the first token of each text (a text without
    words has one neutral token)."""
    w = Words(texts, prefix=PREFIX)
    count = w.count
    a = (w.hash >> np.uint64(40)).astype(np.int64) % WORD_SLOTS
    b = WORD_SLOTS + (w.prefix >> np.uint64(40)).astype(np.int64) % PREFIX_SLOTS
    empty = np.flatnonzero(count == 0)
    if len(empty):
        neutral = WORD_SLOTS + PREFIX_SLOTS   # always the zero vector
        a = np.insert(a, w.first[empty], neutral)
        b = np.insert(b, w.first[empty], neutral)
        count = np.maximum(count, 1)
    return a.astype(np.int32), b.astype(np.int32), np.concatenate(([0], np.cumsum(count)))


@dataclass
class ToxicityModel:
    emb: np.ndarray = None               # (known slots + 1, DIM); the last row is zero
    row_of: np.ndarray = None            # slot -> row of ``emb``; slots that are not known: the last row
    conv: dict = field(default_factory=dict)   # width -> (width, DIM, FILTERS)
    bias: dict = field(default_factory=dict)   # width -> (FILTERS,)
    out: np.ndarray = None
    out_bias: float = 0.0
    platt: tuple[float, float] = (1.0, 0.0)
    prior: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def features(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """Filter outputs at every word (rows of ``emb``), per width (windows may reach
        past a text's end only as zeros)."""
        x = self.emb[a] + self.emb[b]
        n, text_end = len(a), np.repeat(first[1:], np.diff(first))
        left = text_end - np.arange(n)
        got = []
        for width in WIDTHS:
            y = x @ self.conv[width][0]
            for j in range(1, width):
                inside = left[: n - j] > j
                y[: n - j] += (x[j:] @ self.conv[width][j]) * inside[:, None]
            got.append(y)
        return got

    def raw(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> np.ndarray:
        a, b = self.row_of[a], self.row_of[b]
        pooled = [np.maximum(np.maximum.reduceat(y, first[:-1], axis=0) + self.bias[w], 0)
                  for w, y in zip(WIDTHS, self.features(a, b, first))]
        return np.concatenate(pooled, axis=1) @ self.out + self.out_bias

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.emb is None:
            return np.full(len(texts), self.prior)
        out = np.zeros(len(texts))
        for lo, hi in blocks(texts):
            a, b, first = word_ids(texts[lo:hi])
            if first[-1] <= 2 * PIECE_WORDS:    # a very long text is pooled in pieces that overlap
                out[lo:hi] = self.raw(a, b, first)
            else:
                out[lo:hi] = self._raw_long(a, b, first, PIECE_WORDS)
        z = np.clip(self.platt[0] * out + self.platt[1], -30, 30)
        return 1 / (1 + np.exp(-z))

    def one(self, a: np.ndarray, b: np.ndarray) -> float:
        """Output for the words of one text."""
        first = np.array([0, len(a)])
        return float((self.raw(a, b, first) if len(a) <= 2 * PIECE_WORDS else self._raw_long(a, b, first, PIECE_WORDS))[0])

    def _raw_long(self, a, b, first, step):
        got = []
        a, b = self.row_of[a], self.row_of[b]
        for d in range(len(first) - 1):
            best = None
            for at in range(first[d], first[d + 1], step):
                hi = min(first[d + 1], at + step + max(WIDTHS) - 1)
                ys = self.features(a[at:hi], b[at:hi], np.array([0, hi - at]))
                last = hi == first[d + 1]
                ys = [y if last else y[:step] for y in ys]   # windows cut at the piece's end are whole in the next
                top = np.concatenate([y.max(axis=0) for y in ys])
                best = top if best is None else np.maximum(best, top)
                if last:
                    break
            bias = np.concatenate([self.bias[w] for w in WIDTHS])
            got.append(np.maximum(best + bias, 0) @ self.out + self.out_bias)
        return np.array(got)


def _adagrad(param, grad, state, rate):
    state += grad * grad
    param -= rate * grad / (np.sqrt(state) + 1e-7)


def _sum_rows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    return ids[cut], np.add.reduceat(rows[order], cut, axis=0)


class Training:
    """A model and the state of its training; ``flat`` is both as rows of one matrix."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        """``known``: which slots have a row.  Slots of fewer than ``MIN_TEXTS`` training texts stay the zero vector:
        they can't be told from noise, and only the others have a row, which keeps the model small."""
        rng = np.random.default_rng(seed)
        slots = WORD_SLOTS + PREFIX_SLOTS
        self.m = m = ToxicityModel()
        self.zero = zero = int(known.sum())
        m.row_of = np.full(slots + 1, zero, np.int32)
        m.row_of[known] = np.arange(zero, dtype=np.int32)
        parts = []
        for lo in range(0, slots + 1, 1 << 14):      # every slot has its draw, whichever are known
            some = known[lo:lo + (1 << 14)]
            parts.append(rng.normal(0, 0.05, (len(some), DIM))[some].astype(np.float32))
        m.emb = np.concatenate([*parts, np.zeros((1, DIM), np.float32)])
        for w in WIDTHS:
            m.conv[w] = rng.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32)
            m.bias[w] = np.zeros(FILTERS, np.float32)
        m.out = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.rng = rng
        self.state = {name: np.zeros_like(x) for name, x in self._params()}

    def _params(self) -> list[tuple]:
        m = self.m
        return [("emb", m.emb), *[(("conv", w), m.conv[w]) for w in WIDTHS], *[(("bias", w), m.bias[w]) for w in WIDTHS],
                ("out", m.out), ("out_bias", np.array([m.out_bias]))]

    def flat(self) -> np.ndarray:
        """Rows of ``DIM`` parameters and the mean of their states; the embeddings' rows come first."""
        def rows(x):
            x = np.asarray(x, np.float32).reshape(-1)
            return np.pad(x, (0, -len(x) % DIM), "edge").reshape(-1, DIM)
        return np.concatenate([np.column_stack([rows(x), rows(self.state[name]).mean(axis=1)]) for name, x in self._params()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, x in self._params():
            n = -(-x.size // DIM)
            new, state = (y.reshape(-1)[:x.size].reshape(x.shape).astype(x.dtype)
                          for y in (flat[at:at + n, :DIM], np.repeat(flat[at:at + n, DIM:], DIM, axis=1)))
            at += n
            self.state[name] = state
            if name == "out_bias":
                self.m.out_bias = float(new[0])
            elif isinstance(name, tuple):
                getattr(self.m, name[0])[name[1]] = new
            else:
                setattr(self.m, name, new)

    def _tops(self, a: np.ndarray, b: np.ndarray, first: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per width, where each filter is greatest in each text and its output there; a long
        text is searched in pieces that overlap."""
        where = [np.zeros((len(first) - 1, FILTERS), np.int64) for _ in WIDTHS]
        top = [np.full((len(first) - 1, FILTERS), -np.inf, np.float32) for _ in WIDTHS]

        def search(lo: int, hi: int, texts: range, edges: np.ndarray, upto: int) -> None:
            for n, y in enumerate(self.m.features(a[lo:hi], b[lo:hi], edges - lo)):
                for t, s, e in zip(texts, edges[:-1] - lo, edges[1:] - lo):
                    e = min(e, upto - lo)
                    best = s + y[s:e].argmax(axis=0)
                    value = y[best, np.arange(FILTERS)]
                    more = value > top[n][t]
                    where[n][t][more] = best[more] + lo
                    top[n][t][more] = value[more]

        t = 0
        while t < len(first) - 1:
            u = max(t + 1, int(np.searchsorted(first, first[t] + PIECE_WORDS, "right")) - 1)     # whole texts
            if first[u] - first[t] <= 2 * PIECE_WORDS:
                search(first[t], first[u], range(t, u), first[t:u + 1], first[u])
            else:
                for at in range(first[t], first[u], PIECE_WORDS):
                    hi = min(first[u], at + PIECE_WORDS + max(WIDTHS) - 1)
                    search(at, hi, range(t, u), np.array([at, hi]), hi if hi == first[u] else at + PIECE_WORDS)
            t = u
        return where, top

    def step(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One batch."""
        m, state, zero = self.m, self.state, self.zero
        a = m.row_of[np.concatenate([d[0] for d in docs])]
        b = m.row_of[np.concatenate([d[1] for d in docs])]
        first = np.concatenate(([0], np.cumsum([len(d[0]) for d in docs])))
        at, tops = self._tops(a, b, first)
        pooled = [y + m.bias[w] for w, y in zip(WIDTHS, tops)]
        h = np.maximum(np.concatenate(pooled, axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.out_bias, -30, 30)))
        g = ((p - labels) * weight / len(docs)).astype(np.float32)
        dh = g[:, None] * m.out[None, :] * (h > 0)
        rows_ids, rows_grad = [], []
        end = first[1:][:, None]
        for n, w in enumerate(WIDTHS):
            d = dh[:, n * FILTERS:(n + 1) * FILTERS]
            grad = np.zeros_like(m.conv[w])
            for j in range(w):
                pos = at[n] + j
                ok = pos < end
                pos = np.minimum(pos, len(a) - 1)
                dj = d * ok
                x = m.emb[a[pos]] + m.emb[b[pos]]                  # (batch, filters, dim)
                grad[j] = np.einsum("bf,bfd->df", dj, x)
                dx = (dj[:, :, None] * m.conv[w][j].T[None]).reshape(-1, DIM)
                for ids in (a, b):
                    rows_ids.append(ids[pos].reshape(-1))
                    rows_grad.append(dx)
            _adagrad(m.conv[w], grad, state["conv", w], rate)
            _adagrad(m.bias[w], d.sum(axis=0), state["bias", w], rate)
        ids, total = _sum_rows(np.concatenate(rows_ids), np.concatenate(rows_grad))
        ids, total = ids[ids < zero], total[ids < zero]
        state["emb"][ids] += total * total
        m.emb[ids] -= rate * total / (np.sqrt(state["emb"][ids]) + 1e-7)
        _adagrad(m.out, (g[:, None] * h).sum(axis=0), state["out"], rate)
        ob = np.array([m.out_bias])
        _adagrad(ob, np.array([g.sum()]), state["out_bias"], rate)
        m.out_bias = float(ob[0])

    def epoch(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray, epoch: int,
              rng: np.random.Generator) -> None:
        """All rows once, in batches in random order."""
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), BATCH):
            pick = order[lo:lo + BATCH]
            self.step([docs[i] for i in pick], labels[pick], weight[pick], 0.1 / (1 + epoch))


def class_weights(labels: np.ndarray, share: float) -> np.ndarray:
    """Weights by which both classes count alike; ``share`` of the training rows has label 1."""
    return np.where(labels == 1, 0.5 / max(1e-9, share), 0.5 / max(1e-9, 1 - share))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7,
          epochs: int = EPOCHS) -> ToxicityModel:
    """Fit on token arrays ``(word slots, prefix slots)`` of whole texts that are at hand."""
    seen = np.zeros(WORD_SLOTS + PREFIX_SLOTS + 1, np.int64)
    for a, b in docs:
        seen[np.unique(a)] += 1
        seen[np.unique(b)] += 1
    t = Training(_known(seen), seed)
    for epoch in range(epochs):
        t.epoch(docs, labels, class_weights(labels, labels.mean()), epoch, t.rng)
    return t.m


def _known(seen: np.ndarray) -> np.ndarray:
    known = seen >= MIN_TEXTS
    known[WORD_SLOTS + PREFIX_SLOTS] = False
    return known


def platt_scaling(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit of ``y`` on ``z`` (a little ridge)."""
    s = max(1e-6, float(np.abs(z).mean()))
    x = np.stack([z / s, np.ones(len(z))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + np.array([1e-2 * (w[0] - 1), 0])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]) / s, 1e-6), float(w[1])


# ── passes over the written rows ─────────────────────────────────────────────

def _words_of(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32))
            for a, b in zip(batch.column("words").to_pylist(), batch.column("prefixes").to_pylist())]


def known_slots(tokens: DataFrame) -> np.ndarray:
    """The slots that at least ``MIN_TEXTS`` of all rows have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(WORD_SLOTS + PREFIX_SLOTS + 1, np.int64)
        for batch in batches:
            for a, b in _words_of(batch):
                seen[np.unique(a)] += 1
                seen[np.unique(b)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["slot", "n"])

    got = tokens.select("words", "prefixes").mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    seen = np.zeros(WORD_SLOTS + PREFIX_SLOTS + 1, np.int64)
    seen[got.where(F.col("n") >= MIN_TEXTS).select("slot").toArrow().column("slot").to_numpy()] = MIN_TEXTS
    return _known(seen)


_PART_ROWS = 1 << 13


def _averaged(changes: pa.Table) -> pa.Table:
    """Changes of one part of the parameters by several tasks -> each row's mean over the tasks that changed it."""
    at, total, n = None, np.zeros((_PART_ROWS, DIM + 1)), np.zeros(_PART_ROWS)
    for part, _, rows, change in sorted(zip(*(changes.column(c).to_pylist() for c in ("part", "task", "rows", "change")))):
        at, rows = part, np.frombuffer(rows, np.int32)
        total[rows] += np.frombuffer(change, np.float32).reshape(-1, DIM + 1)
        n[rows] += 1
    return pa.table({"part": pa.array([at], pa.int32()),
                     "change": pa.array([(total / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())})


def train_on(tokens: DataFrame, share: float, trainers: int, seed: int = 7, epochs: int = EPOCHS) -> ToxicityModel:
    """As :func:`train`, on all rows of a written table (``label, words, prefixes``), in rounds."""
    sc = tokens.sparkSession.sparkContext
    t = Training(known_slots(tokens), seed)
    rows = tokens.select("label", "words", "prefixes").coalesce(trainers)
    for epoch in range(epochs):
        shared = sc.broadcast((t, epoch))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, now = deepcopy(shared.value)          # the worker's next task begins with them too
            start = mine.flat()
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, now, task])
            held, labels, size = [], [], 0

            def learn() -> None:
                y = np.array(labels)
                mine.epoch(held, y, class_weights(y, share), now, rng)

            for batch in batches:
                for y, words in zip(batch.column("label").to_pylist(), _words_of(batch)):
                    held.append(words)
                    labels.append(y)
                    size += len(words[0])
                    if size >= HELD_WORDS:
                        learn()
                        held, labels, size = [], [], 0
            if held:
                learn()
            change = mine.flat() - start
            for lo in range(0, len(change), _PART_ROWS):
                part = change[lo:lo + _PART_ROWS]
                at = np.flatnonzero(part.any(axis=1))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lo // _PART_ROWS], pa.int32()), pa.array([task], pa.int32()),
                         pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())],
                        names=["part", "task", "rows", "change"])

        got = (rows.mapInArrow(run, "part int, task int, rows binary, change binary")
               .groupBy("part").applyInArrow(_averaged, "part int, change binary").collect())
        flat = t.flat()
        for r in got:
            lo = r["part"] * _PART_ROWS
            flat[lo:lo + _PART_ROWS] += np.frombuffer(r["change"], np.float32).reshape(-1, DIM + 1)[:len(flat) - lo]
        t.load(flat)
        del got, flat
        shared.destroy()
    return t.m


def _sums(rows: DataFrame, of) -> np.ndarray:
    """The sum of ``of(batch)`` over all batches, by task and then in the tasks' order, so that reruns agree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = of(batch) if total is None else total + of(batch)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()),
                                              pa.array([total.tolist()], pa.list_(pa.float64()))], names=["task", "sums"])

    got = rows.coalesce(TRAINERS).mapInArrow(run, "task int, sums array<double>").collect()
    return np.sum([r["sums"] for r in sorted(got, key=lambda r: r["task"])], axis=0)


def scaling_of(rows: DataFrame, weight: tuple[float, float]) -> tuple[float, float]:
    """As :func:`platt_scaling`, of ``label`` on ``z`` over all ``rows`` of a written table, a pass for each step.
    ``weight``: of label 0 and label 1."""
    def taken(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("z").to_numpy(), batch.column("label").to_numpy().astype(float)

    size, n = _sums(rows, lambda b: np.array([np.abs(taken(b)[0]).sum(), b.num_rows]))
    s = max(1e-6, size / n)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        at = w.copy()

        def of(batch: pa.RecordBatch) -> np.ndarray:
            z, y = taken(batch)
            x = np.stack([z / s, np.ones(len(z))], axis=1)
            each = np.where(y == 1, weight[1], weight[0])
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            grad = x.T @ (each * (p - y))
            hess = (x * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x
            return np.concatenate([grad, hess.reshape(-1)])

        total = _sums(rows, of)
        grad = total[:2] + np.array([1e-2 * (w[0] - 1), 0])
        hess = total[2:].reshape(2, 2) + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]) / s, 1e-6), float(w[1])


def best_threshold(bins: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The cut with the least weighted errors, given the weights of both labels in each bin of the grid; of equally good
    cuts the middle of the widest gap; never below 0.5, so that a clean text near the border is let through."""
    order = np.argsort(-bins)
    bins, pos, neg = bins[order], pos[order], neg[order]
    errors = np.concatenate(([pos.sum()], pos.sum() - np.cumsum(pos) + np.cumsum(neg)))
    high = np.concatenate(([1.0], bins / GRID))                # a cut lies between the bins' edges
    low = np.concatenate(((bins + 1) / GRID, [0.0]))
    gap = high - low
    gap[errors > errors.min() + 1e-9 * max(1.0, pos.sum() + neg.sum())] = -1
    i = int(gap.argmax())
    return float(max(0.5, (high[i] + low[i]) / 2))


def language_thresholds(rows: DataFrame, platt: tuple[float, float], weight: tuple[float, float]) -> dict[str, float]:
    """A threshold per language, from all calibration rows of it; a language's bins are at most ``GRID`` rows."""
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = 1 / (1 + np.exp(-np.clip(platt[0] * batch.column("z").to_numpy() + platt[1], -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(np.minimum(np.floor(score * GRID), GRID - 1).astype(np.int32)), batch.column("label")],
                names=["lang", "bin", "label"])

    def cut(t: pa.Table) -> pa.Table:
        bins, n, pos = (t.column(c).to_numpy() for c in ("bin", "n", "pos"))
        some = n.sum() >= MIN_LANG_ROWS and 0 < pos.sum() < n.sum()
        names, cuts = ([t.column("lang")[0].as_py()], [best_threshold(bins, weight[1] * pos, weight[0] * (n - pos))]) if some else ([], [])
        return pa.table({"lang": pa.array(names, pa.string()), "threshold": pa.array(cuts, pa.float64())})

    counts = (rows.select(F.coalesce("lang", F.lit("")).alias("lang"), "z", "label").mapInArrow(binned, "lang string, bin int, label int")
              .groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")))
    return {r["lang"]: r["threshold"] for r in counts.groupBy("lang").applyInArrow(cut, "lang string, threshold double").collect()}


_TOKENS = "doc_id bigint, lang string, label int, words binary, prefixes binary"


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        words, prefixes = [], []
        for lo, hi in blocks(texts):
            a, b, first = word_ids(texts[lo:hi])
            words += [a[s:e].tobytes() for s, e in zip(first[:-1], first[1:])]
            prefixes += [b[s:e].tobytes() for s, e in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("label"),
             pa.array(words, pa.binary()), pa.array(prefixes, pa.binary())],
            names=["doc_id", "lang", "label", "words", "prefixes"])


def fold_of(id_col) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(FOLD))


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Train and calibrate on every labelled row outside the held-out fold; fold 1 is kept for the
    calibration, if both parts have both labels."""
    spark = docs.sparkSession
    usable = written(labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
                     .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold_of("doc_id") != 0))
                     .groupBy("doc_id").agg(F.max("label").alias("label")), "toxicity-labels")
    n = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return ToxicityModel(prior=1.0 if n.get(1) else 0.0)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = lookup_join(texts.where(F.col("doc_id").isNotNull() & (fold_of("doc_id") != 0)), usable, "doc_id", None)
    tokens = written(joined.where("label IS NOT NULL").select("doc_id", "lang", "label", "text").mapInArrow(_token_rows, _TOKENS),
                     "toxicity-words")
    counts = {(r["cal"], r["label"]): r["count"]
              for r in tokens.groupBy((fold_of("doc_id") == 1).alias("cal"), "label").count().collect()}
    both = {y: counts.get((True, y), 0) + counts.get((False, y), 0) for y in (0, 1)}
    if not both[0] or not both[1]:
        return ToxicityModel(prior=1.0 if both[1] else 0.0)
    learn = cal = tokens
    of_learn = of_cal = both
    if all(counts.get((c, y)) for c in (True, False) for y in (0, 1)):
        learn, cal = tokens.where(fold_of("doc_id") != 1), tokens.where(fold_of("doc_id") == 1)
        of_learn, of_cal = ({y: counts[c, y] for y in (0, 1)} for c in (False, True))
    rows = of_learn[0] + of_learn[1]
    model = train_on(learn, of_learn[1] / rows, min(TRAINERS, -(-rows // TRAINER_ROWS)))
    shared = spark.sparkContext.broadcast(model)

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            z = [m.one(a, b) for a, b in _words_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(z, pa.float64())],
                                             names=["lang", "label", "z"])

    scored = written(cal.select("lang", "label", "words", "prefixes").mapInArrow(outputs, "lang string, label int, z double"),
                     "toxicity-outputs")
    true, here = n[1] / (n[0] + n[1]), of_cal[1] / (of_cal[0] + of_cal[1])
    weight = ((1 - true) / max(1e-9, 1 - here), true / max(1e-9, here))
    model.platt = scaling_of(scored, weight)
    model.prior = float(true)
    model.thresholds = language_thresholds(scored, model.platt, weight)
    return model


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, threshold, rejected`` of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)     # at most 23 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            score = m.scores(batch.column("text").to_pylist())
            cut = np.array([m.thresholds.get(x or "", 0.5) for x in batch.column("lang").to_pylist()], float)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(cut), pa.array(score >= cut)],
                names=["doc_id", "score", "threshold", "rejected"])

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
            .mapInArrow(run, "doc_id bigint, score double, threshold double, rejected boolean"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, threshold, rejected`` of every document."""
    return (score_texts(docs, fit(docs, labels))
            .select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "rejected"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows the model rejects, every column as it was."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names = batch.schema.names
            texts = [t or "" for t in batch.column(names.index("text")).to_pylist()]
            langs = batch.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(texts)
            cut = np.array([m.thresholds.get(x or "", 0.5) for x in langs], float)
            yield batch.filter(pa.array(m.scores(texts) < cut))

    return docs.mapInArrow(run, docs.schema)
