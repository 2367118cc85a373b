"""Running totals over a global order, and lookups joined to rows with hot keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.joins import MAX_BROADCAST_ROWS
from cohortline.llm.tables import written

#: Copies of a lookup that is too large to broadcast; rows of a hot key are dealt over them.
SALTS = 64
#: Largest lookup handed to all executors, in bytes of its text keys.
MAX_BROADCAST_BYTES = 16 << 20


def running_total(df: DataFrame, order: list[str], value: str, out: str, group: str | None = None) -> DataFrame:
    """``df`` with ``out``: the sum of the bigint column ``value`` over this row and all rows
    before it in ``order`` (ascending, nulls first); with ``group`` (a non-null bigint column, the first of
    ``order``) over the rows of the same group only.

    The rows are range-partitioned and sorted, so a group of any size is spread over
    consecutive partitions; each partition is summed as a stream and written once, with its
    number (sampled bounds may differ on a second evaluation); what stands in earlier partitions
    is summed over one row per partition and group and joined back.  ``order`` should tell
    rows apart, or rows that it ties stay in one partition."""
    if group is not None and order[0] != group:
        raise ValueError("a grouped order starts with its group")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, last = 0, None                                # sum so far of the group that is open
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            v = b.column(names.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            run = np.cumsum(v)
            if group is None:
                run += held
                held = int(run[-1])
            else:
                g = b.column(names.index(group)).to_numpy(zero_copy_only=False)
                first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
                before = (run - v)[first]                   # of this batch, before each of its groups
                if g[0] == last:
                    before[0] -= held
                run = run - np.repeat(before, np.diff(np.append(first, n)))
                held, last = int(run[-1]), g[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(run)],
                                             names=[*names, "_part", "_run"])

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(ordered.mapInArrow(summed, schema), "running")
    keys = ["_part", *([group] if group else [])]
    window = Window.partitionBy(*([group] if group else [])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = (rows.groupBy(*keys).agg(F.max("_run").alias("_sum"))
               .select(*keys, F.coalesce(F.sum("_sum").over(window), F.lit(0)).alias("_before")))
    return rows.join(earlier, keys).select(*names, (F.col("_run") + F.col("_before")).alias(out))


def with_lookup(rows: DataFrame, lookup: DataFrame, key: str, spread: str) -> DataFrame:
    """``rows`` with the further columns of ``lookup`` (one row per ``key``; null is a key too), for
    rows of which one key may hold a large share.

    A lookup is broadcast after a check of its rows and key bytes; a larger one is repeated
    ``SALTS`` times and joined on (key, salt), the salt a hash of the row's column ``spread``."""
    payload = [c for c in lookup.columns if c != key]
    small = lookup.select(F.col(key).alias("_key"), *payload)
    size = small.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col("_key").cast("string"))).alias("b")).first()
    if size["n"] <= MAX_BROADCAST_ROWS and (size["b"] or 0) <= MAX_BROADCAST_BYTES:
        out = rows.join(F.broadcast(small), rows[key].eqNullSafe(F.col("_key")))
    else:
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
        copies = small.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(copies, salted[key].eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_copy")))
    return out.select(*rows.columns, *payload)
