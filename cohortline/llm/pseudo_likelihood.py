"""LM scoring by masked pseudo-likelihood.

A small network sees the ``WINDOW`` words on either side of a masked word and
predicts it: the context words' embeddings (one table per place) are summed
through tanh, and three softmaxes lead down a tree with a leaf for each of the ``VOCABULARY``
most frequent words and for ``RARE`` classes of all others (by their first letters).
A word of such a class has its share of the class's count over all documents as its
probability within the class, so every word has a probability of its own.
A text's score is the sum over all its words of the log-probability given both sides:
``log_likelihood`` and ``mean_log_prob``.  ``class_log_likelihood`` and ``mean_class_log_prob`` leave
out which word of its class a rare word is.

The tree's size is the network's, at every size of the corpus; the counts of all words are a
Spark table that grows with it.  The ``KNOWN`` most frequent words' counts are handed to every task (a
bounded table), those of the others are joined by word, with the words of a text added up first.

Training starts from a common network, fitted by one task to a bounded sample; then
each task goes once over its own texts (at most ``TRAINERS`` tasks, partitions are put together
beyond) and the results are averaged by words seen, in two steps of sums per
parameter slice.  The network, and so the scores, depend on how the texts are dealt to tasks; with the
same partitions they are the same.

Defined results.  Null and empty texts and texts without words have 0 words, scores 0
and null means.  Repeated rows give repeated rows (of equal scores); with no words in the corpus at
all, or an empty table, nothing is trained and the result has those rows only.  Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.tables import doc_text, written
from cohortline.llm.textnum import Words, blocks, mix, sequence_keys

VOCABULARY = 4096
RARE = 256               # classes of other words, by their first three letters
FAN = 16                 # children of a node below the tree's root
WINDOW = 2
DIM = 16
BATCH = 32_768
SAMPLE_TEXTS = 1500      # of the common start
START_WORDS = 2_000_000  # of the common start, at most
TRAINERS = 4096
KNOWN = 262_144          # words whose counts every task holds (4 MB)
SLICES = 16
BLOCK = 1 << 18          # characters worked on at a time
UNITS = 1e9              # logs of counts are summed in whole 1e-9, whatever their order

IDS = VOCABULARY + RARE
#: nodes of the tree's levels: the root, its children, theirs; a leaf's path is its id in digits of ``FAN``
NODES = (1, IDS // FAN ** 2, IDS // FAN)
WIDTH = (IDS // FAN ** 2, FAN, FAN)


def word_class(words: Words) -> np.ndarray:
    return (words.prefix % np.uint64(RARE)).astype(np.int64)


class Vocabulary:
    """Word hashes by frequency rank with their counts, and the count of all words of each class
    beyond the ``VOCABULARY`` first."""

    def __init__(self, hashes: np.ndarray, class_counts: np.ndarray, counts: np.ndarray | None = None):
        rank = np.arange(len(hashes))
        order = np.argsort(hashes)
        self.hash, self.rank = hashes[order], rank[order]
        counts = np.ones(len(hashes), np.int64) if counts is None else counts
        self.log_count = np.round(np.log(np.maximum(counts[order], 1)) * UNITS).astype(np.int64)
        self.log_class = np.round(np.log(np.maximum(class_counts, 1)) * UNITS).astype(np.int64)

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of every word, and its place in ``log_count`` (-1 where its count is not held)."""
        leaf = VOCABULARY + word_class(words)
        place = np.full(len(leaf), -1)
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
            known = self.hash[at] == words.hash
            place[known] = at[known]
            rank = np.where(known, self.rank[at], VOCABULARY)
            leaf = np.where(rank < VOCABULARY, rank, leaf)
        return leaf.astype(np.uint16), place


def contexts(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Context ids ``(2 * WINDOW, words)``; ``IDS`` beyond a text's ends."""
    n = len(ids)
    out = np.full((2 * WINDOW, n), IDS, np.uint16)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for k, step in enumerate([*range(-WINDOW, 0), *range(1, WINDOW + 1)]):
        if abs(step) >= n:
            continue
        here, there = (slice(-step, n), slice(0, n + step)) if step < 0 else (slice(0, n - step), slice(step, n))
        same = text[here] == text[there]
        out[k, here][same] = ids[there][same]
    return out


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {"emb": rng.normal(0, 0.1, (2 * WINDOW, IDS + 1, DIM)).astype(np.float32), "hid": np.zeros(DIM, np.float32)}
        for k, (n, m) in enumerate(zip(NODES, WIDTH)):
            self.p[f"w{k}"] = rng.normal(0, 0.1, (n, DIM, m)).astype(np.float32)
            self.p[f"b{k}"] = np.zeros((n, m), np.float32)
        self.s = {k: np.full_like(v, 1e-3) for k, v in self.p.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at:at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return self

    def hidden(self, ctx: np.ndarray) -> np.ndarray:
        h = np.take(self.p["emb"][0], ctx[0], axis=0)
        h += self.p["hid"]
        for k in range(1, 2 * WINDOW):
            h += np.take(self.p["emb"][k], ctx[k], axis=0)
        return np.tanh(h, out=h)

    def levels(self, y: np.ndarray, h: np.ndarray) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
        """For each level of the tree, leaves ``y`` in ascending order and their hidden vectors as columns: the
        runs ``(node, start, end)`` of words that pass through a node, their scores over its children (a row
        per child), and the child taken."""
        y = y.astype(np.int32)
        for k in range(3):
            at = y // FAN ** (2 - k)
            node = at // WIDTH[k]
            z = np.empty((WIDTH[k], len(y)), np.float32)
            cut = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            runs = list(zip(node[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(y)]))
            w, b = self.p[f"w{k}"], self.p[f"b{k}"]
            for g, lo, hi in runs:
                np.matmul(w[g].T, h[:, lo:hi], out=z[:, lo:hi])
                z[:, lo:hi] += b[g][:, None]
            np.clip(z, -60, 60, out=z)                   # exp() needs no shift then
            yield k, runs, z, at - node * WIDTH[k]

    def log_probs(self, ids: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Log-probability of every word's leaf given its context."""
        out = np.empty(len(ids))
        for lo in range(0, len(ids), BATCH):
            order = np.argsort(ids[lo:lo + BATCH], kind="stable")      # 16-bit ids: sorted by digits
            y, here = ids[lo:lo + BATCH][order], np.arange(len(order))
            h = np.ascontiguousarray(self.hidden(ctx[:, lo:lo + BATCH][:, order]).T)
            total = np.zeros(len(y))
            for _, _, z, child in self.levels(y, h):
                total += z[child, here]
                total -= np.log(np.exp(z, out=z).sum(axis=0))
            out[lo + order] = total
        return out

    def gradients(self, y: np.ndarray, ctx: np.ndarray) -> dict:
        """Of the mean loss; those of the embeddings as ``(ids, rows)`` per place."""
        n = len(y)
        order = np.argsort(y, kind="stable")
        y, ctx, here = y[order], ctx[:, order], np.arange(n)
        h = np.ascontiguousarray(self.hidden(ctx).T)
        dh, grads = np.zeros_like(h), {}
        for k, runs, z, child in self.levels(y, h):
            np.exp(z, out=z)
            z /= z.sum(axis=0) * n
            z[child, here] -= 1 / n
            w = self.p[f"w{k}"]
            gw, gb = np.zeros_like(w), np.zeros_like(self.p[f"b{k}"])
            for g, lo, hi in runs:
                part = z[:, lo:hi]
                gw[g] = h[:, lo:hi] @ part.T
                gb[g] = part.sum(axis=1)
                dh[:, lo:hi] += w[g] @ part
            grads[f"w{k}"], grads[f"b{k}"] = gw, gb
        dh *= 1 - h * h
        grads["hid"] = dh.sum(axis=1)
        dh = np.ascontiguousarray(dh.T)
        for k in range(2 * WINDOW):
            order = np.argsort(ctx[k], kind="stable")
            ids = ctx[k][order]
            cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
            grads["emb", k] = (ids[cut], np.add.reduceat(np.take(dh, order, axis=0), cut, axis=0))
        return grads

    def step(self, y: np.ndarray, ctx: np.ndarray, rate: float) -> None:
        """One Adagrad step on a batch."""
        for name, grad in self.gradients(y, ctx).items():
            if isinstance(name, tuple):
                self._update(name[0], grad[1], rate, (name[1], grad[0]))
            else:
                self._update(name, grad, rate)

    def _update(self, name: str, grad: np.ndarray, rate: float, at=Ellipsis) -> None:
        self.s[name][at] += grad * grad
        self.p[name][at] -= rate * grad / np.sqrt(self.s[name][at])

    def train(self, ids: np.ndarray, ctx: np.ndarray, rate: float) -> None:
        for lo in range(0, len(ids), BATCH):
            self.step(ids[lo:lo + BATCH], ctx[:, lo:lo + BATCH], rate)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, class, n``: every word hash of the corpus with its class and count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = b.column("text").to_pylist()
            for lo, hi in blocks(parts, 4 * BLOCK):
                words = Words(parts[lo:hi], prefix=3)
                w, at, n = np.unique(words.hash, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.view(np.int64)), pa.array(word_class(words)[at].astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["word", "class", "n"])

    return (texts.select("text").mapInArrow(run, "word bigint, class int, n bigint")
            .groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("n")))


def vocabulary(counts: DataFrame) -> Vocabulary:
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).toArrow().sort_by([("n", "descending"), ("word", "ascending")])     # a bounded head
    word, kind, n = (top.column(c).to_numpy().astype(np.int64) for c in ("word", "class", "n"))
    rest = np.zeros(RARE, np.int64)
    for r in counts.groupBy("class").agg(F.sum("n").alias("n")).collect():    # RARE rows
        rest[r["class"]] = r["n"]
    np.subtract.at(rest, kind[:VOCABULARY], n[:VOCABULARY])
    return Vocabulary(word.view(np.uint64), rest, n)


def _tokens(texts: list[str], vocab: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, Words, int, int]]:
    for lo, hi in blocks(texts, BLOCK):
        w = Words(texts[lo:hi], prefix=3)
        yield *vocab.find(w), w, lo, hi


class _Batches:
    """Blocks of words put together to whole training batches."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.held, self.size, self.seen = net, rate, [], 0, 0

    def add(self, ids: np.ndarray, first: np.ndarray) -> None:
        if len(ids):
            self.held.append((ids, contexts(ids, first)))
            self.size += len(ids)
            self.seen += len(ids)
        if self.size >= BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            self.net.train(np.concatenate([x for x, _ in self.held]), np.concatenate([c for _, c in self.held], axis=1), self.rate)
            self.held, self.size = [], 0


def common_start(texts: DataFrame, shared) -> np.ndarray:
    """The network fitted by one task to at most ``SAMPLE_TEXTS`` texts, whole, in order of their hashes, until
    ``START_WORDS`` words are reached."""
    key = F.xxhash64("doc_id", "text")
    few = texts.select(key.alias("k")).orderBy("k").limit(SAMPLE_TEXTS).distinct()          # keys, not texts
    sample = texts.withColumn("k", key).join(F.broadcast(few), "k", "left_semi").dropDuplicates(["k"]).coalesce(1).sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, words = Network(), 0
        small = [(ids, w.first) for b in batches for ids, _, w, _, _ in _tokens(b.column("text").to_pylist(), shared.value)
                 if (words := words + len(ids)) <= START_WORDS + 2 * BLOCK]
        for _ in range(3):
            todo = _Batches(net, 0.1)
            for ids, first in small:
                todo.add(ids, first)
                if todo.size >= BATCH // 4:              # many small steps to begin with
                    todo.flush()
            todo.flush()
        yield pa.RecordBatch.from_arrays([pa.array([net.flat().tobytes()], pa.binary())], names=["net"])

    got = sample.select("text").mapInArrow(run, "net binary").collect()
    return np.frombuffer(got[0]["net"], np.float32) if got else Network().flat()


def train(texts: DataFrame, vocab: Vocabulary) -> Network:
    """The averaged network of all tasks, each trained on its whole share."""
    sc = texts.sparkSession.sparkContext
    words = sc.broadcast(vocab)
    common = sc.broadcast(common_start(texts, words))    # about two megabytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, mine = words.value, Network().load(common.value)
        for s in mine.s.values():
            s += 1.0 / 8192                              # gentle first steps from the common start
        todo = _Batches(mine, 0.03)
        for b in batches:
            for ids, _, w, _, _ in _tokens(b.column("text").to_pylist(), voc):
                todo.add(ids, w.first)
        todo.flush()
        seen = todo.seen
        if seen:
            parts = np.array_split(mine.flat().astype(np.float64) * seen, SLICES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SLICES), pa.int32()), pa.array([seen] * SLICES, pa.int64()),
                 pa.array([x.astype(np.float32).tobytes() for x in parts], pa.binary())], names=["slice", "seen", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for k, n, raw in zip(*(b.column(c).to_pylist() for c in ("slice", "seen", "total"))):
                x = np.frombuffer(raw, np.float32).astype(np.float64)
                if k in sums:
                    sums[k][0] += n
                    sums[k][1] += x
                else:
                    sums[k] = [n, x.copy()]
        for k, (n, x) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([x.astype(np.float32).tobytes()], pa.binary())],
                names=["slice", "seen", "total"])

    ddl = "slice int, seen bigint, total binary"
    rows = texts.select("text").coalesce(TRAINERS).mapInArrow(run, ddl)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("total"), F.lit(SLICES))).repartition("slice", "salt").drop("salt")
    rows = rows.mapInArrow(add, ddl).repartition("slice").mapInArrow(add, ddl)
    got = {r["slice"]: (r["seen"], r["total"]) for r in rows.collect()}       # one network
    net = Network().load(common.value)
    if got:
        net.load(np.concatenate([np.frombuffer(got[k][1], np.float32) / got[k][0] for k in range(SLICES)]))
    return net


def score(texts: DataFrame, vocab: Vocabulary, net: Network, counts: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_prob, class_log_likelihood, mean_class_log_prob`` of every text."""
    shared = texts.sparkSession.sparkContext.broadcast((vocab, net.flat()))

    def rows(ids, key, word, n, own, ll):
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(key.view(np.int64)), pa.array(word.view(np.int64)), pa.array(n.astype(np.int64)), own, ll],
            names=["doc_id", "key", "word", "n", "own", "ll"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row with ``ll`` for each text, then its words whose counts are not held here, with their number."""
        voc, flat = shared.value
        mine = Network().load(flat)
        for b in batches:
            doc_ids = b.column("doc_id")
            for ids, place, w, lo, hi in _tokens(b.column("text").to_pylist(), voc):
                total, own, key = np.zeros(hi - lo), np.zeros(hi - lo, np.int64), sequence_keys(w)[0]
                other = np.flatnonzero(ids >= VOCABULARY)
                if len(ids):
                    has = np.flatnonzero(w.count)
                    total[has] = np.add.reduceat(mine.log_probs(ids, contexts(ids, w.first)), w.first[has])
                    within = -voc.log_class[ids[other].astype(np.int64) - VOCABULARY]
                    held = place[other] >= 0
                    within[held] += voc.log_count[place[other][held]]
                    np.add.at(own, w.doc[other], within)
                    other = other[~held]
                part = doc_ids.slice(lo, hi - lo)
                # a text's own row has no word: its place in the join is spread by id and key
                spread = mix(key ^ mix(part.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)))
                yield rows(part, key, spread, w.count, pa.array(own), pa.array(total))
                if len(other):
                    order = np.lexsort((w.hash[other], w.doc[other]))
                    d, h = w.doc[other][order], w.hash[other][order]
                    cut = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (h[1:] != h[:-1]))))
                    yield rows(part.take(pa.array(d[cut])), key[d[cut]], h[cut], np.diff(np.append(cut, len(d))),
                               pa.nulls(len(cut), pa.int64()), pa.nulls(len(cut), pa.float64()))

    known = counts.where("n > 1").select("word", F.round(F.log("n") * UNITS).cast("bigint").alias("log_n"))    # log 1 is 0
    text = F.col("ll").isNotNull()
    sums = (texts.mapInArrow(run, "doc_id bigint, key bigint, word bigint, n bigint, own bigint, ll double").join(known, "word", "left")
            .groupBy("doc_id", "key")
            .agg(F.max(F.when(text, F.col("n"))).alias("n_words"), F.max("ll").alias("ll"), F.count("ll").cast("int").alias("copies"),
                 F.sum(F.when(text, F.col("own")).otherwise(F.col("n") * F.coalesce("log_n", F.lit(0)))).alias("own")))
    sums = sums.withColumn("word_ll", F.col("ll") + F.col("own") / F.col("copies") / UNITS)

    def mean(total: str) -> F.Column:
        return F.when(F.col("n_words") > 0, F.round(F.col(total) / F.col("n_words"), 6))

    return (sums.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
            .select("doc_id", "n_words", F.round("word_ll", 4).alias("log_likelihood"), mean("word_ll").alias("mean_log_prob"),
                    F.round("ll", 4).alias("class_log_likelihood"), mean("ll").alias("mean_class_log_prob")))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    texts = doc_text(docs)
    counts = written(word_counts(texts), "word-counts")       # read three times below
    vocab = vocabulary(counts)
    return score(texts, vocab, train(texts, vocab), counts)
