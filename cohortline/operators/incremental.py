"""Refresh of the classification when further order files arrive, without reading the old orders again.

The state below a folder, one ``gen=N`` per refresh:

* ``days``: classified (customer, day) facts with amounts, of the days the refresh brought or changed;
* ``late``: customers whose earlier days a refresh replaced;
* ``customers``: last day and orders of the refresh's days, per customer;
* ``platforms``: orders per customer and platform;
* ``commits``: written last.  A generation counts once its commit is there; an unfinished refresh is
  not read and its retry replaces it.

A customer whose new orders all lie after the last known day is *in order*: only the
new days are classified, starting from that day and the number of orders so far.  A customer with a
late date has the known days merged with the new ones (counts and cents add up, the
first order of a day is the lesser id) and classified again.  Both give what a full rebuild over
all orders gives, bit for bit, as every sum is over integers.

Shuffled are the new orders' days, the state rows of the customers that they touch and, when the state is
read, the (small) list of late customers; the other customers' days are scanned at most.
Tables with a row per customer or day are merged, never broadcast: Spark judges them by the size of their
files, and the late customers of a large refresh don't fit the driver.
Order ids must be new: the ingest checks that (``streaming.ingest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.joins import lookup_join
from cohortline.operators import marts as M
from cohortline.operators.classify import _DAY_AMOUNTS, classify_days, day_type, order_days, with_day_facts
from cohortline.plans.materialize import path_exists
from cohortline.session import scratch_path

_SUMS = ["n_rows", "n_orders", *[f"{k}_{x}" for k in _DAY_AMOUNTS for x in ("c", "n")]]
_RAW_DAY = [S.USER, S.DATE, *_SUMS, "first_order_uuid", "first_gb_c"]
_CLASS = ["prev_day", "orders_before", "day_type"]

# fixed, so that a generation without rows reads like any other
_SCHEMAS = {
    "days": f"{S.USER} string, {S.DATE} date, " + ", ".join(f"{c} bigint" for c in _SUMS)
            + ", first_order_uuid string, first_gb_c bigint, prev_day date, orders_before bigint, day_type string",
    "late": f"{S.USER} string",
    "customers": f"{S.USER} string, last_day date, n_rows bigint",
    "platforms": f"{S.USER} string, {S.PLATFORM} string, n bigint",
}


class State:
    """The refreshable classification below ``root`` (shared storage)."""

    def __init__(self, spark: SparkSession, root: str, gap_days: int = S.REACTIVATION_GAP_DAYS):
        self.spark, self.root, self.gap_days = spark, root.rstrip("/"), gap_days

    # ── generations ─────────────────────────────────────────────────────────

    def generations(self) -> int:
        """Number of committed refreshes."""
        n = 0
        while path_exists(self.spark, f"{self.root}/commits/gen={n}/_SUCCESS"):
            n += 1
        return n

    def _write(self, df: DataFrame, table: str, gen: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/gen={gen}")

    def _read(self, table: str) -> DataFrame | None:
        """Rows of the committed generations, with the column ``gen``."""
        paths = [f"{self.root}/{table}/gen={g}" for g in range(self.generations())]
        if not paths:
            return None
        return self.spark.read.schema(f"{_SCHEMAS[table]}, gen int").option("basePath", f"{self.root}/{table}").parquet(*paths)

    # ── reading ─────────────────────────────────────────────────────────────

    def days(self) -> DataFrame:
        """The classified days that hold: those of a late customer from its last replacement on."""
        days, late = self._read("days"), self._read("late")
        if days is None:
            raise ValueError(f"no committed refresh below {self.root}")
        since = late.groupBy(S.USER).agg(F.max("gen").alias("_since"))
        known = lookup_join(days, since, S.USER, None)          # a customer has a day once a generation at most
        return known.where(F.col("_since").isNull() | (F.col("gen") >= F.col("_since"))).drop("_since", "gen")

    def master_customer_table(self, as_of=None) -> DataFrame:
        """M1 from the state alone (``as_of`` defaults to the last day in it)."""
        days = self.days()
        counts = self._read("platforms").groupBy(S.USER, S.PLATFORM).agg(F.sum("n").alias("n"))
        return M.customer_facts_of_days(days, M.platform_of_counts(counts), as_of).select(*M.MASTER_COLUMNS)

    # ── refreshing ──────────────────────────────────────────────────────────

    def refresh(self, new: DataFrame) -> DataFrame:
        """Take in new cleaned orders; returns the late customers ``(user_uuid)``."""
        gen = self.generations()
        # what arrived is one Parquet table from here on: it is read several times
        arrived = scratch_path(self.spark, "arrived")
        new.where(F.col(S.USER).isNotNull()).write.parquet(arrived)
        new = self.spark.read.schema(new.schema).parquet(arrived)
        fresh_path = scratch_path(self.spark, "fresh_days")
        order_days(new).select(*_RAW_DAY).write.parquet(fresh_path)
        fresh = self.spark.read.parquet(fresh_path)
        touched = fresh.groupBy(S.USER).agg(F.min(S.DATE).alias("_first"))
        customers = self._read("customers")
        if customers is None:
            late = touched.select(S.USER).limit(0)
            known = touched.select(S.USER, F.lit(None).cast("date").alias("_last"), F.lit(0).cast("bigint").alias("_orders")).limit(0)
        else:
            known = (customers.join(touched.select(S.USER).hint("merge"), S.USER, "left_semi").groupBy(S.USER)
                     .agg(F.max("last_day").alias("_last"), F.sum("n_rows").alias("_orders")))
            late = touched.join(known.hint("merge"), S.USER).where("_first <= _last").select(S.USER)
        self._write(late, "late", gen)
        late = self.spark.read.schema(_SCHEMAS["late"]).parquet(f"{self.root}/late/gen={gen}")
        days = self._in_order(fresh.join(late.hint("merge"), S.USER, "left_anti"), known)
        if customers is not None:
            days = days.unionByName(self._again(fresh, late))
        self._write(days.select(*_RAW_DAY, *_CLASS), "days", gen)
        self._write(fresh.groupBy(S.USER).agg(F.max(S.DATE).alias("last_day"), F.sum("n_rows").alias("n_rows")), "customers", gen)
        self._write(new.groupBy(S.USER, S.PLATFORM).agg(F.count(F.lit(1)).alias("n")), "platforms", gen)
        self._write(self.spark.range(1).select(F.lit(gen).alias("n")), "commits", gen)
        return late

    def _in_order(self, fresh: DataFrame, known: DataFrame) -> DataFrame:
        w = Window.partitionBy(S.USER).orderBy(S.DATE)
        before = F.coalesce(F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return fresh.join(known.hint("merge"), S.USER, "left").select(
            *_RAW_DAY, F.coalesce(F.lag(S.DATE).over(w), F.col("_last")).alias("prev_day"),
            (before + F.coalesce("_orders", F.lit(0))).alias("orders_before")).withColumn("day_type", day_type(self.gap_days))

    def _again(self, fresh: DataFrame, late: DataFrame) -> DataFrame:
        both = (self.days().select(*_RAW_DAY).join(late.hint("merge"), S.USER, "left_semi")
                .unionByName(fresh.join(late.hint("merge"), S.USER, "left_semi")))
        merged = both.groupBy(S.USER, S.DATE).agg(
            *[F.sum(c).alias(c) for c in _SUMS], F.min("first_order_uuid").alias("first_order_uuid"),
            F.min_by("first_gb_c", "first_order_uuid").alias("first_gb_c"))
        return classify_days(merged, self.gap_days)

    # ── order level ─────────────────────────────────────────────────────────

    def classified(self, orders: DataFrame) -> DataFrame:
        """M0 rows of whole customer days (all of a day's orders), from the state's day facts."""
        return with_day_facts(orders, self.days())


def refresh_classified(state: State, classified: DataFrame, orders: DataFrame, new: DataFrame) -> DataFrame:
    """M0 after ``new`` arrived: ``classified`` (M0 so far) without the late customers' rows, the new orders
    of customers in order, and every order of the late ones.  ``orders`` are the cleaned orders so far; only the
    late customers' are read from them."""
    late = state.refresh(new)
    facts = state.days()
    anew = orders.join(late.hint("merge"), S.USER, "left_semi").unionByName(new)
    touched = facts.join(anew.select(S.USER, S.DATE).distinct().hint("merge"), [S.USER, S.DATE], "left_semi")
    return classified.join(late.hint("merge"), S.USER, "left_anti").unionByName(with_day_facts(anew, touched))
