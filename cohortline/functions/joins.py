"""Lookup joins and the size up to which a lookup may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest lookup we hand to executors as a broadcast.
MAX_BROADCAST_ROWS = 100_000

# Largest lookup handed to executors, in bytes of its rows as text.
MAX_BROADCAST_BYTES = 32 << 20
SALTS = 32


def lookup_join(rows: DataFrame, lookup: DataFrame, on: str | list[str], spread: str | None) -> DataFrame:
    """``rows`` left-joined with ``lookup`` (one row per ``on``), where one key may hold a large
    share of the rows.

    The lookup is measured first (pass a written table) and broadcast if it is
    small; a larger one is repeated ``SALTS`` times and joined on (key, salt), the salt
    being a hash of the row's column ``spread`` (None where no key has many rows: joined on the key alone).

    A larger one is always merged: Spark's estimate knows neither how far files unpack nor the copies, and would
    have the driver broadcast millions of rows as a small table."""
    top = lookup.limit(MAX_BROADCAST_ROWS + 1)
    size = top.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.to_json(F.struct(*lookup.columns)))).alias("b")).first()
    if size["n"] <= MAX_BROADCAST_ROWS and (size["b"] or 0) <= MAX_BROADCAST_BYTES:
        return rows.join(F.broadcast(lookup), on, "left")
    if spread is None:
        return rows.join(lookup.hint("merge"), on, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [on] if isinstance(on, str) else list(on)
    return salted.join(copies.hint("merge"), [*keys, "_salt"], "left").drop("_salt")
