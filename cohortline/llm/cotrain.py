"""Quality classifier by co-training two views of a document.

The text view sees hashed words and the make-up of the characters; the metadata
view sees source, language, length and line layout.  Both start from the labelled
sample; in every round each gives the other all unlabelled documents whose
calibrated probability is ``SURE`` or more for a class.  Each view's score is then
calibrated on labelled rows kept apart, the calibrated log-odds are combined, and
every whole document is scored.

The features of all unlabelled documents are written once (sparse, without texts).
A round is one pass over them: both views score every document, and for the
documents given to a view the gradient of its loss and a bound of the curvature are
summed by feature.  The view is then fitted to the labelled rows' loss and the
quadratic bound that these sums make; it lies above the loss of the given documents,
so no step raises it.  At most ``SAMPLE_LABELLED`` labelled documents (smallest hashes
of ids) are fitted.  Labelled rows whose crc32(id) mod 5 is 0 are never fitted nor given; every
document without a label, null ids included, is offered in every round.

Defined results.  Null and empty texts are scored by their other features.  Without
labels of both classes every score is the share of label 1 (0 if there are none).
Labels with nulls are ignored, missing metadata columns count as null, repeated rows
give repeated rows and an empty table an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.tables import written
from cohortline.llm.textnum import Words, blocks, codepoints
from cohortline.llm.toxicity import FOLD, fold_of, platt_scaling

WORD_SLOTS = 1024
SAMPLE_LABELLED = 6_000
ROUNDS = 4
SURE = 0.95
GIVEN = 0.5              # weight of the given documents' mean loss; that of the labelled rows is 1
META_SLOTS = 48
TEXT_SIZE = WORD_SLOTS + 48
META_SIZE = META_SLOTS + 8
SIZE = TEXT_SIZE + META_SIZE


def text_view(texts: list[str]) -> np.ndarray:
    """Hashed word shares (square roots), shares of character kinds, and measures of repetition."""
    out = np.zeros((len(texts), TEXT_SIZE), np.float32)
    for lo, hi in blocks(texts):
        part = texts[lo:hi]
        w = Words(part)
        n = np.maximum(w.count, 1)
        slot = (w.hash >> np.uint64(54)).astype(np.int64)
        counts = np.bincount(w.doc * WORD_SLOTS + slot, minlength=len(part) * WORD_SLOTS).reshape(len(part), WORD_SLOTS)
        out[lo:hi, :WORD_SLOTS] = np.sqrt(counts / n[:, None])
        cp, starts = codepoints(part)
        ends = np.append(starts[1:], len(cp)) - 1
        doc = np.repeat(np.arange(len(part)), ends - starts + 1)
        length = np.maximum(ends - starts, 1)
        # ASCII signs one by one (33..47, 58..64, 91..96, 123..126), then digits, capitals, blanks
        group = np.full(128, -1, np.int64)
        signs = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
        group[signs] = np.arange(len(signs))
        group[48:58], group[65:91], group[32] = 32, 33, 34
        g = np.where(cp < 128, group[np.minimum(cp, 127)], 35)
        ok = g >= 0
        shares = np.bincount(doc[ok] * 36 + g[ok], minlength=len(part) * 36).reshape(len(part), 36) / length[:, None]
        out[lo:hi, WORD_SLOTS:WORD_SLOTS + 36] = np.sqrt(shares) * 2
        pairs = np.unique((w.doc << 32) | (w.hash >> np.uint64(32)).astype(np.int64)) >> 32
        distinct = np.bincount(pairs, minlength=len(part)) / n
        letters = np.bincount(w.doc, (w.end - w.begin), minlength=len(part)) / n
        out[lo:hi, WORD_SLOTS + 36] = distinct
        out[lo:hi, WORD_SLOTS + 37] = np.minimum(letters / 10, 3)
        out[lo:hi, WORD_SLOTS + 38] = np.log1p(w.count) / 8
        out[lo:hi, WORD_SLOTS + 39] = distinct * np.log1p(w.count) / 8
        out[lo:hi, WORD_SLOTS + 40] = w.count == 0
    out[:, -1] = 1
    return out


def meta_view(texts: list[str], lang: list, source: list, n_chars: list) -> np.ndarray:
    """Hashed source and language, length, and the layout of lines."""
    out = np.zeros((len(texts), META_SIZE), np.float32)
    for i, t in enumerate(texts):
        out[i, zlib.crc32(f"source {source[i]}".encode()) % 32] = 1
        out[i, 32 + zlib.crc32(f"lang {lang[i]}".encode()) % 16] = 1
        lines = t.split("\n")
        size = n_chars[i] if n_chars[i] is not None else len(t)
        out[i, META_SLOTS:] = (np.log1p(max(size, 0)) / 10, np.log1p(len(lines)) / 5, min(len(t) / len(lines) / 400, 3),
                               len(set(lines)) / len(lines), max(map(len, lines)) / max(1, len(t)),
                               sum(not x.strip() for x in lines) / len(lines), size < 100, 1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 250,
             bound: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Weighted ridge logistic regression (full-batch Adam); ``bound`` adds a quadratic
    with its gradient and diagonal curvature at a point."""
    w = np.zeros(x.shape[1], np.float32)
    a, b = np.zeros_like(w), np.zeros_like(w)
    weight = (weight / weight.sum()).astype(np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * w
        if bound is not None:
            g += bound[0] + bound[1] * (w - bound[2])
        a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
        w -= 0.1 * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8)
    return w


@dataclass
class QualityModel:
    prior: float = 0.0
    text: np.ndarray = None
    meta: np.ndarray = None
    text_cal: tuple[float, float] = (1.0, 0.0)
    meta_cal: tuple[float, float] = (1.0, 0.0)
    blend: np.ndarray = None

    def odds(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of both views."""
        return np.stack([self.text_cal[0] * (xt @ self.text) + self.text_cal[1],
                         self.meta_cal[0] * (xm @ self.meta) + self.meta_cal[1]], axis=1).clip(-20, 20)

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.text is None:
            return np.full(len(xt), self.prior), np.full((len(xt), 2), self.prior)
        z = self.odds(xt, xm)
        return _sigmoid(z @ self.blend[:2] + self.blend[2]), _sigmoid(z)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def packed(xt: np.ndarray, xm: np.ndarray) -> list[bytes]:
    """Both views of each document in one: places (16 bits) and values (16 bits) other than 0."""
    out = []
    for row in np.concatenate([xt, xm], axis=1).astype(np.float16):
        at = np.flatnonzero(row)
        out.append(at.astype(np.uint16).tobytes() + row[at].tobytes())
    return out


def unpacked(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, values, and the start of each document (none is empty: both views end in a 1)."""
    n = np.array([len(r) // 4 for r in raw])
    at = np.frombuffer(b"".join(r[:len(r) // 2] for r in raw), np.uint16).astype(np.int64)
    v = np.frombuffer(b"".join(r[len(r) // 2:] for r in raw), np.float16).astype(float)
    return at, v, np.concatenate(([0], np.cumsum(n)[:-1]))


def given_sums(raw: list[bytes], w: np.ndarray, cal: tuple, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the documents that one view gives to the other: gradient and curvature by
    feature of the view it is given to, and the weights of both views (text, metadata)."""
    at, v, first = unpacked(raw)
    doc = np.repeat(np.arange(len(raw)), np.diff(np.append(first, len(at))))
    grad, curve, mass = np.zeros(SIZE), np.zeros(SIZE), np.zeros(2)
    of_text = at < TEXT_SIZE
    raw_score = [np.bincount(doc[m], v[m] * w[at[m]], len(raw)) for m in (of_text, ~of_text)]
    sure = [_sigmoid(a * z + b) for (a, b), z in zip(cal, raw_score)]
    for k, mine in enumerate((of_text, ~of_text)):
        p = sure[1 - k]
        y = p >= SURE
        c = np.where(y, 0.5 / max(1e-9, rate), 0.5 / max(1e-9, 1 - rate)) * (y | (p <= 1 - SURE))
        d, j, x = doc[mine], at[mine], v[mine]
        grad += np.bincount(j, x * (c * (_sigmoid(raw_score[k]) - y))[d], SIZE)
        length = np.bincount(d, np.abs(x), len(raw))
        curve += np.bincount(j, np.abs(x) * (c * length / 4)[d], SIZE)
        mass[k] = c.sum()
    return grad, curve, mass


def all_given(others: DataFrame, w: np.ndarray, cal: tuple, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``given_sums`` over all unlabelled documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grad, curve, mass = np.zeros(SIZE), np.zeros(SIZE), np.zeros(2)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                g, h, m = given_sums(b.column("x").slice(lo, 4096).to_pylist(), w, cal, rate)
                grad, curve, mass = grad + g, curve + h, mass + m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 2, dtype=np.int32)), pa.array(np.append(grad, mass)),
                                          pa.array(np.append(curve, mass))], names=["at", "grad", "curve"])

    rows = others.select("x").mapInArrow(run, "at int, grad double, curve double").groupBy("at").agg(F.sum("grad"), F.sum("curve"))
    out = np.zeros((2, SIZE + 2))
    for at, g, h in rows.collect():                    # one row per feature
        out[:, at] = g, h
    return out[0, :SIZE], out[1, :SIZE], out[0, SIZE:]


def cotrain(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, calibrate, others: DataFrame,
            rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of both views after the exchange of confident pseudo-labels; ``calibrate``
    gives both views' scales and shifts for their weights."""
    rate = y.mean()
    weight = np.where(y == 1, 0.5 / max(1e-9, rate), 0.5 / max(1e-9, 1 - rate))
    wt, wm = logistic(xt, y, weight), logistic(xm, y, weight)
    for _ in range(rounds):
        w = np.concatenate([wt, wm])
        grad, curve, mass = all_given(others, w, calibrate(wt, wm), rate)
        fitted = []
        for k, (x, at) in enumerate(((xt, slice(0, TEXT_SIZE)), (xm, slice(TEXT_SIZE, SIZE)))):
            scale = GIVEN / mass[k] if mass[k] else 0.0
            bound = tuple(a.astype(np.float32) for a in (scale * grad[at], scale * curve[at], w[at]))
            fitted.append(logistic(x, y, weight, bound=bound))
        wt, wm = fitted
    return wt, wm


_VIEW_DDL = "doc_id bigint, label int, xt binary, xm binary"


def _base(docs: DataFrame) -> DataFrame:
    def col(name, kind):
        return (F.col(name).cast(kind) if name in docs.columns else F.lit(None).cast(kind)).alias(name)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       col("lang", "string"), col("source", "string"), col("n_chars", "bigint"))


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts, lang, source, n_chars = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
    return text_view(texts), meta_view(texts, lang, source, n_chars)


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    base = _base(docs)
    usable = (labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    n = {r["label"]: r["count"] for r in usable.where(fold_of("doc_id") != 0).groupBy("label").count().collect()}
    if not n.get(0) or not n.get(1):
        return QualityModel(prior=1.0 if n.get(1) else 0.0)
    key = F.xxhash64("doc_id")
    labelled = usable.where(fold_of("doc_id") != 0).orderBy(key, "doc_id").limit(SAMPLE_LABELLED)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(packed(*_views(part)), pa.binary())], names=["doc_id", "x"])

    # the features, not the texts, meet the labels' ids
    others = (base.mapInArrow(features, "doc_id bigint, x binary")
              .join(usable.select("doc_id"), "doc_id", "left_anti"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xt, xm = _views(b)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([x.astype(np.float16).tobytes() for x in xt], pa.binary()),
                 pa.array([x.tobytes() for x in xm], pa.binary())], names=["doc_id", "label", "xt", "xm"])

    picked = F.broadcast(labelled)                     # at most the sample's size
    rows = base.join(picked, "doc_id").select("doc_id", "label", "text", "lang", "source", "n_chars").mapInArrow(run, _VIEW_DDL).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["xt"]))
    y = np.array([r["label"] for r in rows])
    xt = np.stack([np.frombuffer(r["xt"], np.float16) for r in rows]).astype(np.float32)
    xm = np.stack([np.frombuffer(r["xm"], np.float32) for r in rows])
    cal = np.array([zlib.crc32(str(r["doc_id"]).encode()) % FOLD == 1 for r in rows]) 
    learn = ~cal
    if not learn.any() or len(set(y[learn])) < 2 or len(set(y[cal])) < 2:
        learn = cal = np.ones(len(y), bool)
    share = n[1] / (n[0] + n[1])
    m = QualityModel(prior=share)
    if len(set(y[learn])) < 2:
        return m
    yc, ones = y[cal], np.ones(cal.sum())

    def calibrate(wt, wm):
        return platt_scaling(xt[cal] @ wt, yc, ones), platt_scaling(xm[cal] @ wm, yc, ones)

    m.text, m.meta = cotrain(xt[learn], xm[learn], y[learn], calibrate, written(others, "unlabelled"))    # read every round
    m.text_cal, m.meta_cal = calibrate(m.text, m.meta)
    z = m.odds(xt[cal], xm[cal])
    blend = logistic(np.column_stack([z, np.ones(len(z))]).astype(np.float32), yc, ones, ridge=1e-2)
    m.blend = np.maximum(blend, [0, 0, -50])           # a view never counts against itself
    return m


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, text_score, meta_score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))      # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                s, views = m.scores(*_views(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(s.astype(float)), pa.array(views[:, 0].astype(float)), pa.array(views[:, 1].astype(float))],
                    names=["doc_id", "score", "text_score", "meta_score"])

    rows = _base(docs).mapInArrow(run, "doc_id bigint, score double, text_score double, meta_score double")
    return rows.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "text_score", "meta_score")
