"""Vector code compression: product codes by Lloyd rounds over active entries.

Vectors become integers (``floor(256 x)``) and are cut into 16 equal parts; every part
position has a codebook of at most 64 entries, at first the parts of the vectors with the smallest ids.
A round assigns each part to its nearest entry and moves every used entry to the
floored mean of its parts.

*Active entries.*  Each part keeps its entry and the exact squared distance to it.  Where
the last update left that entry in place, the stored distance still holds, every entry
that stayed is still no nearer (ties go to the lower index), and only the entries that moved are compared
with it.  A part whose own entry moved rescans the whole codebook.  Both give the nearest entry of
least index, so the result is that of full scans.

*At scale.*  Rows are never shuffled: a round is one pass over the vectors with their codes and
distances, written once, and one pass that adds up each task's parts by (position, entry); those
sums (at most 1,024 rows a task) are added by Spark.  The codebooks themselves, 64 entries of the
vector's width, are all that passes through the driver.

Dropped: vectors that are null or hold a null or non-finite component.  Shorter vectors
count as padded with zeros to the longest one, rounded up to a multiple of 16.  Null ids come after
all others, equal ids in order of their vectors; repeated rows are rows of their own; null labels are one label;
fewer than 64 vectors give as many entries; an empty table gives an empty result.  Vectors whose
errors could pass 64 bits raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm.running import with_lookup
from cohortline.llm.tables import written

PARTS = 16
ENTRIES = 64
SCALE = 256
ROUNDS = 2
_BLOCK = 4096        # rows compared at a time: bounds a task's memory at _BLOCK x ENTRIES distances


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the entries ``c`` (int64)."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, c)
    a = d.argmin(axis=1)                     # the first of equals: the lowest index
    return a, d[np.arange(len(x)), a]


def assign(x: np.ndarray, c: np.ndarray, moved: np.ndarray, at: np.ndarray, dist: np.ndarray) -> None:
    """Bring ``at`` and ``dist`` (entry and distance of each part) up to the codebook ``c`` of
    which the entries ``moved`` have changed since they were found."""
    if not moved.any():
        return
    stale = moved[at]
    if stale.any():
        at[stale], dist[stale] = nearest(x[stale], c)
    live = np.flatnonzero(~stale)
    if len(live):
        changed = np.flatnonzero(moved)
        j, d = nearest(x[live], c[changed])
        e = changed[j]
        better = (d < dist[live]) | ((d == dist[live]) & (e < at[live]))
        at[live[better]], dist[live[better]] = e[better], d[better]


class _Round:
    """One assignment pass: picklable function from batches to batches."""

    def __init__(self, book: np.ndarray, moved: np.ndarray, final: bool):
        self.book, self.moved, self.final = book, moved, final     # [parts, entries, width], [parts, entries]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = self.book.shape
        for whole in batches:
            for lo in range(0, whole.num_rows, _BLOCK):
                b = whole.slice(lo, _BLOCK)
                n = b.num_rows
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts * width)
                first = "code" not in b.schema.names
                if first:
                    at, dist = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
                else:
                    at = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                    dist = b.column("dist").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, parts)
                for p in range(parts):
                    x = v[:, p * width:(p + 1) * width]
                    if first:
                        at[:, p], dist[:, p] = nearest(x, self.book[p])
                    else:
                        assign(x, self.book[p], self.moved[p], at[:, p], dist[:, p])
                codes = [r.tobytes() for r in at.astype(np.uint8)]
                if self.final:
                    tail = [pa.array([c.hex() for c in codes]), pa.array(dist.sum(axis=1))]
                else:
                    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * parts)
                    tail = [b.column("v"), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(dist.ravel()))]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), *tail],
                                                 names=["vec_id", "label", *(("code", "error") if self.final else ("v", "code", "dist"))])


def _sums(parts: int, entries: int, width: int):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows * parts, width)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, parts).astype(np.int64)
            slot = (code + np.arange(parts) * entries).ravel()
            np.add.at(total, slot, v)
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]),
             pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * width), pa.array(total[used].ravel()))],
            names=["slot", "n", "sums"])
    return add


def updated(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebooks after one update: floored means of the parts each entry holds; unused entries stay."""
    parts, entries, width = book.shape
    own = state.select("v", "code").mapInArrow(_sums(parts, entries, width), "slot int, n bigint, sums array<bigint>")
    by_slot = own.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = book.reshape(parts * entries, width).copy()
    for r in by_slot.collect():                                 # at most PARTS x ENTRIES rows
        out[r["slot"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out.reshape(book.shape)


def codebook_digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in book.ravel().tolist()).encode()).hexdigest()


def integers(vector: Column) -> Column:
    """``floor(256 x)`` of each component; null for a vector that is null or not finite."""
    x = vector.cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(x.isNotNull() & ~bad, F.transform(x, lambda v: F.floor(v * SCALE)))


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` of every vector that is kept."""
    kept = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"),
                          integers(F.col(vector_col)).alias("v")).where(F.col("v").isNotNull())
    size = kept.agg(F.max(F.size("v")).alias("d"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most")).first()
    width = -(-(size["d"] or 0) // PARTS)
    if width * PARTS * (2 * (size["most"] or 0)) ** 2 >= 1 << 63:
        raise ValueError(f"components of up to {size['most']} / {SCALE} in {size['d']} dimensions: errors would pass 64 bits")
    kept = kept.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width * PARTS) - F.size("v"))))
    first = [r["v"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()]
    book = np.array(first, np.int64).reshape(len(first), PARTS, width).transpose(1, 0, 2)
    book = np.ascontiguousarray(book)
    moved = np.ones(book.shape[:2], bool)
    kind = kept.schema["label"].dataType
    ends = [T.StructField("vec_id", T.LongType()), T.StructField("label", kind)]
    stored = T.StructType([*ends, T.StructField("v", T.ArrayType(T.LongType())), T.StructField("code", T.BinaryType()),
                           T.StructField("dist", T.ArrayType(T.LongType()))])
    state = kept
    for _ in range(ROUNDS if len(first) else 0):
        state = written(state.mapInArrow(_Round(book, moved, False), stored), "vector-codes")
        new = updated(state, book)
        book, moved = new, (new != book).any(axis=2)
    final = T.StructType([*ends, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    coded = written(state.mapInArrow(_Round(book, moved, True), final), "vector-errors")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return with_lookup(coded, labels, "label", "code").withColumn("codebooks_sha256", F.lit(codebook_digest(book)))
