"""Exact rank of rows inside a key without putting a key's rows in one task.

``Window.partitionBy(key).orderBy(x)`` sends every row of a key to one task;
for a key that holds a large share of the data that task does all the work.
``rank_within`` instead

1. range-partitions and sorts the rows by (key, order) — Spark samples the
   bounds, so a huge key is spread over many consecutive partitions;
2. numbers rows inside each partition (``monotonically_increasing_id`` is
   sequential within a sorted partition) and writes them once: sampled bounds
   differ from one evaluation to the next, so both steps below must read the
   same written rows;
3. aggregates per (partition, key): the key's first local position and its
   row count; a window per key over *partitions* (at most one row per
   partition the key spans) gives the rows of that key in earlier partitions;
4. joins those per-(partition, key) facts back on (partition, key) — a key
   that spans many partitions is spread over as many join groups.

rank = local position − key's first local position + rows in earlier
partitions + 1.  The order column must make (key, order) unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.session import scratch_path

_LOCAL_BITS = 33  # monotonically_increasing_id = partition index << 33 | row index


def rank_within(df: DataFrame, keys: list[str], order_col: str, name: str = "rank",
                num_partitions: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """Return ``keys + [order_col] + carry + [name]`` with ``name`` the 1-based
    position of the row within its key ordered by ``order_col``.

    ``carry`` columns travel with the rows, so callers need no join back.
    """
    cols = [*keys, order_col]
    extra = [c for c in (carry or []) if c not in cols]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.select(*cols, *extra).repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    mid = F.monotonically_increasing_id()
    pos = ordered.select(*cols, *extra, F.shiftright(mid, _LOCAL_BITS).alias("_part"),
                         mid.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)).alias("_local"))
    path = scratch_path(df.sparkSession, "ranked_rows")
    pos.write.parquet(path)
    pos = df.sparkSession.read.schema(pos.schema).parquet(path)
    per_part = pos.groupBy("_part", *keys).agg(F.min("_local").alias("_lstart"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    stats = per_part.select("_part", *keys, "_lstart",
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.col("_local") - F.col("_lstart") + F.col("_before") + 1
    return pos.join(stats, ["_part", *keys]).select(*cols, *extra, rank.alias(name))
