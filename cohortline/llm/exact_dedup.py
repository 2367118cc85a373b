"""Exact dedup: counting quotient filters per partition, merged by sorted
remainders; fingerprints seen more than once go to byte verification.

1. Every task fingerprints its rows (64 bits of the SHA-256 of the normalised
   text) into counting quotient filters, one per block of leading bits.
2. The filters of a block meet in one task and merge losslessly.  A copy group of
   any size is one slot with a count in each filter, so it never makes a hot task.
3. Rows whose fingerprint counts more than one are compared byte for byte: their
   whole normalised texts are grouped (pre-aggregated before the shuffle, and the
   rows salted, so that a group with a third of all rows is spread).  The other rows are
   left out before it, by a broadcast of the repeated fingerprints up to ``MAX_BROADCAST`` of them and by a
   salted join beyond.
4. All rows learn their group by (fingerprint, digest).

Defined results.  Null text counts as empty, and empty texts are equal to one
another.  ``doc_id`` is expected to be unique; rows that repeat an id share its
fate, a null id is smaller than any other and a group of null ids only keeps
them.  An empty table gives an empty result.  Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm.quotient_filter import CountingQuotientFilter, split_blocks
from cohortline.llm.tables import doc_text, written

BLOCK_BITS = 11          # 2,048 blocks: at 10^10 texts about five million slots (80 MB) meet in a task
FILTER_ROWS = 1 << 20    # a task hands on its filters after so many fingerprints
SALTS = 8
MAX_BROADCAST = 1_000_000    # fingerprints of 8 bytes handed to every task; more are joined


def _digests(texts: pa.Array) -> list[bytes]:
    lowered = pc.ascii_lower(texts)
    return [hashlib.sha256(t.as_buffer()).digest() for t in lowered]


def _fingerprints(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = _digests(b.column("text"))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(_fingerprints(digests).view(np.int64)), pa.array([d.hex() for d in digests])],
            names=["doc_id", "fp", "text_sha256"])


def _candidate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lowered = pc.ascii_lower(b.column("text"))
        fp = np.frombuffer(b"".join(hashlib.sha256(t.as_buffer()).digest()[:8] for t in lowered), ">u8")
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(fp.astype(np.uint64).view(np.int64)), lowered], names=["doc_id", "fp", "norm"])


def _partition_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def out():
        packed = [f.pack() for f in split_blocks(np.concatenate(held), BLOCK_BITS)]
        return pa.RecordBatch.from_pylist(packed, schema=_FILTER_ARROW)

    for b in batches:
        if b.num_rows:
            held.append(_fingerprints(_digests(b.column("text"))))
        if sum(map(len, held)) >= FILTER_ROWS:
            yield out()
            held = []
    if held:
        yield out()


_FILTER_ARROW = pa.schema([("block", pa.int64()), ("quotient_bits", pa.int64()), ("occupieds", pa.binary()),
                           ("runends", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])
_FILTER_DDL = "block bigint, quotient_bits bigint, occupieds binary, runends binary, remainders binary, counts binary"


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the filters of each block in a partition; give the entries that count
    more than one.  The task holds what is merged so far and one batch."""
    merged: dict[int, CountingQuotientFilter] = {}
    for b in batches:
        new: dict[int, list[CountingQuotientFilter]] = {}
        for row in b.to_pylist():
            new.setdefault(row["block"], []).append(CountingQuotientFilter.unpack(BLOCK_BITS, row))
        for block, fs in new.items():
            old = [merged[block]] if block in merged else []
            merged[block] = CountingQuotientFilter.merge(old + fs)
    for f in merged.values():
        fp, n = f.decode()
        again = n > 1
        if again.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp[again].view(np.int64)), pa.array(n[again])], names=["fp", "seen"])


def repeated_fingerprints(texts: DataFrame) -> DataFrame:
    """``(fp, seen)`` of all fingerprints that occur more than once in ``text``."""
    filters = texts.select("text").mapInArrow(_partition_filters, _FILTER_DDL)
    return filters.repartition("block").mapInArrow(_merge_blocks, "fp bigint, seen bigint")


def copy_groups(texts: DataFrame) -> DataFrame:
    """Verified groups of equal texts: ``(fp, text_sha256, keep_id, group_size)``."""
    repeated = written(repeated_fingerprints(texts).select("fp"), "repeated")
    rows = (texts.mapInArrow(_candidate_rows, "doc_id bigint, fp bigint, norm string")
            .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")))
    if repeated.count() <= MAX_BROADCAST:
        # rows that occur once go in the task that reads them
        rows = rows.join(F.broadcast(repeated), "fp", "left_semi")
    else:
        salts = F.array(*[F.lit(i) for i in range(SALTS)])
        rows = rows.join(repeated.select("fp", F.explode(salts).alias("salt")), ["fp", "salt"], "left_semi")
    # byte verification: equal fingerprint and equal whole text; first within a salt, then over all
    part = rows.groupBy("fp", "salt", "norm").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return (part.groupBy("fp", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
            .where("group_size > 1")
            .select("fp", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; the largest id stays."""
    texts = doc_text(docs, id_col, text_col)
    groups = copy_groups(texts).withColumnRenamed("keep_id", "group_keep")
    rows = texts.mapInArrow(_digest_rows, "doc_id bigint, fp bigint, text_sha256 string")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("group_keep"))
    return (rows.join(groups, ["fp", "text_sha256"], "left")
            .select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                    F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256"))
