"""Counting quotient filter over 64-bit fingerprints, in numpy.

A fingerprint splits into a quotient (its high bits) and a remainder (the low
bits).  The slots hold the remainders sorted inside each quotient's run; the
``occupieds`` bits name the quotients that have a run, the ``runends`` bits mark
the last slot of each run, and every slot has a count.  Quotient and remainder
together are the whole fingerprint, so nothing is lost: decoding gives back the
sorted fingerprints, and merging filters is a merge of sorted remainders that
adds counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sorted_counts(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(fingerprints, kind="stable")   # radix/merge: runs that are sorted stay cheap
    fp, n = fingerprints[order], counts[order]
    if not len(fp):
        return fp, n
    first = np.flatnonzero(np.concatenate(([True], fp[1:] != fp[:-1])))
    return fp[first], np.add.reduceat(n, first)


@dataclass
class CountingQuotientFilter:
    block: int            # the leading ``block_bits`` bits, equal for all entries
    block_bits: int
    quotient_bits: int    # bits after the block that form the quotient
    occupieds: np.ndarray  # packed bits, one per quotient
    runends: np.ndarray    # packed bits, one per slot
    remainders: np.ndarray  # uint64, one per slot
    counts: np.ndarray      # int64, one per slot

    @staticmethod
    def build(block: int, block_bits: int, fingerprints: np.ndarray,
              counts: np.ndarray | None = None) -> "CountingQuotientFilter":
        if counts is None:
            counts = np.ones(len(fingerprints), np.int64)
        fp, n = _sorted_counts(fingerprints, counts)
        qbits = max(3, int(len(fp)).bit_length())
        rbits = np.uint64(64 - block_bits - qbits)
        q = ((fp >> rbits) & np.uint64((1 << qbits) - 1)).astype(np.int64)
        r = fp & np.uint64((1 << int(rbits)) - 1)
        occ = np.zeros(1 << qbits, bool)
        occ[q] = True
        end = np.ones(len(fp), bool)
        if len(fp):
            end[:-1] = q[1:] != q[:-1]
        return CountingQuotientFilter(block, block_bits, qbits, np.packbits(occ), np.packbits(end), r, n)

    def decode(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted fingerprints and their counts."""
        n = len(self.remainders)
        ends = np.flatnonzero(np.unpackbits(self.runends, count=n))
        runs = np.flatnonzero(np.unpackbits(self.occupieds, count=1 << self.quotient_bits))
        q = np.repeat(runs, np.diff(np.concatenate(([-1], ends)))).astype(np.uint64)
        rbits = np.uint64(64 - self.block_bits - self.quotient_bits)
        head = np.uint64((self.block << (64 - self.block_bits)) & ((1 << 64) - 1)) if self.block_bits else np.uint64(0)
        return head | (q << rbits) | self.remainders, self.counts

    @staticmethod
    def merge(filters: list["CountingQuotientFilter"]) -> "CountingQuotientFilter":
        """One filter of all entries; counts of equal fingerprints add up."""
        parts = [f.decode() for f in filters]
        fp = np.concatenate([p[0] for p in parts])
        n = np.concatenate([p[1] for p in parts])
        return CountingQuotientFilter.build(filters[0].block, filters[0].block_bits, fp, n)

    # plain bytes for Spark rows
    def pack(self) -> dict:
        return {"block": self.block, "quotient_bits": self.quotient_bits,
                "occupieds": self.occupieds.tobytes(), "runends": self.runends.tobytes(),
                "remainders": self.remainders.tobytes(), "counts": self.counts.tobytes()}

    @staticmethod
    def unpack(block_bits: int, row: dict) -> "CountingQuotientFilter":
        return CountingQuotientFilter(
            row["block"], block_bits, row["quotient_bits"],
            np.frombuffer(row["occupieds"], np.uint8), np.frombuffer(row["runends"], np.uint8),
            np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.int64))


def split_blocks(fingerprints: np.ndarray, block_bits: int) -> list[CountingQuotientFilter]:
    """One filter per leading-bit block that has entries."""
    fp, n = _sorted_counts(fingerprints, np.ones(len(fingerprints), np.int64))
    block = (fp >> np.uint64(64 - block_bits)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(fp) else np.zeros(0, np.int64)
    out = []
    for a, b in zip(cut, np.append(cut[1:], len(fp))):
        out.append(CountingQuotientFilter.build(int(block[a]), block_bits, fp[a:b], n[a:b]))
    return out
