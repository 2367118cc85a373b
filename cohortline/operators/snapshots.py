"""Persisted runs of the customer table, and where an excess over the last run sits.

Each run writes one row per customer into ``run_id=N`` below a folder; a run counts
once its write has ended (Spark's ``_SUCCESS`` mark), so an unfinished one is neither read nor in
the way of a retry.  Two runs are compared by customer id in one full outer join; every
customer then adds to the cell (acquisition cohort, country) it is in now and takes
from the cell it was in before, so the cells' changes sum to the change of the whole table exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.dates import month_start
from cohortline.functions.money import cents_to_usd, to_cents
from cohortline.plans.materialize import path_exists

SNAPSHOT_SCHEMA = f"{S.USER} string, acquisition_cohort date, {S.COUNTRY} string, total_orders bigint, gross_cents bigint"


def customer_snapshot(clean: DataFrame) -> DataFrame:
    """One row per customer: cohort and country of the first order (date, then order id), orders, cents."""
    first = F.min(F.struct(F.col(S.DATE), F.col(S.ORDER), F.col(S.COUNTRY)))
    return (clean.where(F.col(S.USER).isNotNull()).groupBy(S.USER)
            .agg(first.alias("f"), F.count(S.ORDER).alias("total_orders"), F.sum(to_cents(S.GROSS_USD)).alias("gross_cents"))
            .select(S.USER, month_start(F.col("f")[S.DATE]).alias("acquisition_cohort"), F.col("f")[S.COUNTRY].alias(S.COUNTRY),
                    "total_orders", "gross_cents"))


def _run_path(root: str, run_id: int) -> str:
    return f"{root.rstrip('/')}/run_id={run_id}"


def run_ids(spark: SparkSession, root: str) -> list[int]:
    """Finished runs below ``root``, ascending."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(hpath)]
    ids = sorted(int(n.split("=")[1]) for n in names if n.startswith("run_id="))
    return [i for i in ids if path_exists(spark, _run_path(root, i) + "/_SUCCESS")]


def write_snapshot(snapshot: DataFrame, root: str) -> int:
    """Write the next run; returns its id."""
    run_id = max(run_ids(snapshot.sparkSession, root), default=0) + 1
    snapshot.select(*[f.split()[0] for f in SNAPSHOT_SCHEMA.split(", ")]).write.mode("overwrite").parquet(_run_path(root, run_id))
    return run_id


def read_snapshot(spark: SparkSession, root: str, run_id: int) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(_run_path(root, run_id))


def customer_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Both runs side by side per customer: ``change`` is ``added``, ``gone``, ``moved`` (another cohort or
    country), ``changed`` (orders or cents) or ``same``."""
    cols = ["acquisition_cohort", S.COUNTRY, "total_orders", "gross_cents"]
    b = before.select(F.col(S.USER), F.struct(*cols).alias("before"))
    n = now.select(F.col(S.USER), F.struct(*cols).alias("now"))
    cell = lambda side: F.struct(F.col(side)["acquisition_cohort"].alias("m"), F.col(side)[S.COUNTRY].alias("c"))
    change = (F.when(F.col("before").isNull(), "added").when(F.col("now").isNull(), "gone")
              .when(~cell("before").eqNullSafe(cell("now")), "moved")
              .when(~F.col("before").eqNullSafe(F.col("now")), "changed").otherwise("same"))
    return b.join(n, S.USER, "full").select(S.USER, "before", "now", change.alias("change"))


def excess_by_cell(before: DataFrame, now: DataFrame) -> DataFrame:
    """Contributions to the change in customers, by cohort and country, largest first.

    ``delta = added - gone + moved_in - moved_out`` per cell, and the deltas sum to the change of the
    whole table; likewise ``delta_usd``.  ``share_pct`` is the cell's part of that change (null if there is none)."""
    d = customer_changes(before, now)
    counts = ["customers_before", "customers_now", "added", "gone", "moved_in", "moved_out"]

    def side(name: str, sign: int, here: str, alone: str, moved: str):
        r, is_alone, is_moved = F.col(name), F.col("change") == alone, F.col("change") == "moved"
        value = {here: F.lit(1), alone: is_alone.cast("int"), moved: is_moved.cast("int")}
        return F.struct(r["acquisition_cohort"].alias("acquisition_cohort"), r[S.COUNTRY].alias(S.COUNTRY),
                        *[value.get(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
                        (sign * F.coalesce(r["gross_cents"], F.lit(0))).alias("cents"))

    # a customer of both runs gives two rows, others one
    sides = F.array_compact(F.array(
        F.when(F.col("before").isNotNull(), side("before", -1, "customers_before", "gone", "moved_out")),
        F.when(F.col("now").isNotNull(), side("now", 1, "customers_now", "added", "moved_in"))))
    cells = d.select(F.inline(sides)).groupBy("acquisition_cohort", S.COUNTRY).agg(
        *[F.sum(c).alias(c) for c in counts], F.sum("cents").alias("cents"))
    delta = (F.col("customers_now") - F.col("customers_before")).alias("delta")
    cells = cells.select("*", delta)
    # one row per month and country from here on
    everything = Window.partitionBy()
    total = F.sum("delta").over(everything)
    order = Window.orderBy(F.abs("delta").desc(), F.asc_nulls_last("acquisition_cohort"), F.asc_nulls_last(S.COUNTRY))
    share = F.round(F.try_divide(F.col("delta") * 1000.0, total.cast("double"))) / 10
    return cells.select(F.row_number().over(order).alias("rank"), "acquisition_cohort", S.COUNTRY, *counts, "delta",
                        cents_to_usd("cents").alias("delta_usd"), share.alias("share_pct"))


def compare_last_runs(spark: SparkSession, root: str) -> DataFrame:
    """``excess_by_cell`` of the last two finished runs below ``root``."""
    ids = run_ids(spark, root)
    if len(ids) < 2:
        raise ValueError(f"{len(ids)} finished runs below {root}, two are needed")
    return excess_by_cell(read_snapshot(spark, root, ids[-2]), read_snapshot(spark, root, ids[-1]))
