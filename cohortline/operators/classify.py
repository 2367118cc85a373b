"""Order classification: new / reactivated / retained.

Rule: an order is ``new`` when it is the customer's first order, ordered by
(operational_view_date, order_uuid); ``reactivated`` when more than
``gap_days`` days passed since the previous order; ``retained`` otherwise.

Plan shape (skew-safe):

1. ``order_days``: aggregate orders to the (customer, day) grain with partial
   (map-side) aggregation.  A customer owning a third of all rows is spread
   over many (customer, day) keys and pre-combined before the shuffle.
2. A window per customer over *days* yields the previous active day.  A window
   group holds at most one row per calendar day in the data, so its size is
   bounded by the calendar span, not by the customer's order volume.
3. Only the first order of a day can be ``new``/``reactivated``; any later
   order the same day has a 0-day gap and is ``retained``.

Marts consume the day grain directly; the order-level view re-attaches the day
facts with one equi-join on (customer, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.joins import lookup_join
from cohortline.functions.money import to_cents
from cohortline.operators.sequence import rank_within
from cohortline.session import scratch_path

# Amount columns carried to the day grain as exact cents.
_DAY_AMOUNTS = {"gb": S.GROSS_USD, "m1": S.MARGIN_USD, "vfm": S.VFM_USD, "gp": S.PROFIT_USD}


def order_days(clean: DataFrame, amounts: bool = True, first_order: bool = True) -> DataFrame:
    """One row per (user_uuid, operational_view_date).

    Columns: n_rows (orders), n_orders (non-null order ids); with ``amounts``
    ``{k}_c`` (cent sum) and ``{k}_n`` (non-null count) per amount; with
    ``first_order`` the day's first order id and ``first_gb_c`` (its cents).
    The first-order columns take a string minimum, which Spark aggregates by
    sorting; callers that only need day counts leave them out and keep a
    hash aggregate.
    """
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count(S.ORDER).alias("n_orders"),
    ]
    if first_order:
        aggs.append(F.min(S.ORDER).alias("first_order_uuid"))
    if amounts:
        for k, c in _DAY_AMOUNTS.items():
            aggs += [F.sum(to_cents(c)).alias(f"{k}_c"), F.count(c).alias(f"{k}_n")]
        if first_order:
            aggs.append(F.min_by(to_cents(S.GROSS_USD), F.col(S.ORDER)).alias("first_gb_c"))
    return clean.groupBy(S.USER, S.DATE).agg(*aggs)


def day_type(gap_days: int) -> Column:
    """Type of a day's first order, from the customer's active day before it."""
    return (F.when(F.col("prev_day").isNull(), F.lit("new"))
             .when(F.datediff(F.col(S.DATE), F.col("prev_day")) > F.lit(gap_days), F.lit("reactivated"))
             .otherwise(F.lit("retained")))


def classify_days(days: DataFrame, gap_days: int = S.REACTIVATION_GAP_DAYS) -> DataFrame:
    """Add prev_day, orders_before and day_type (type of the day's first order)."""
    w = Window.partitionBy(S.USER).orderBy(S.DATE)
    prev_day = F.lag(S.DATE).over(w)
    before = F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = days.withColumns({"prev_day": prev_day, "orders_before": F.coalesce(before, F.lit(0).cast("bigint"))})
    return out.withColumn("day_type", day_type(gap_days))


def classified_days(clean: DataFrame, gap_days: int = S.REACTIVATION_GAP_DAYS, amounts: bool = True,
                    first_order: bool = True) -> DataFrame:
    return classify_days(order_days(clean, amounts, first_order), gap_days)


def day_type_contributions(cdays: DataFrame) -> DataFrame:
    """Split each classified day into per-order-type parts.

    The first order carries the day type; the remaining ``n_rows - 1`` orders
    are ``retained``.  Output: user, date, order_type, rows, gb_c, gb_n.
    """
    first_n = F.when(F.col("first_gb_c").isNull(), 0).otherwise(1)
    rest_n = F.col("gb_n") - first_n
    rest_c = F.when(rest_n > 0, F.col("gb_c") - F.coalesce(F.col("first_gb_c"), F.lit(0)))
    parts = F.array(
        F.struct(F.col("day_type").alias("order_type"), F.lit(1).cast("bigint").alias("rows"),
                 F.col("first_gb_c").alias("gb_c"), first_n.cast("bigint").alias("gb_n")),
        F.struct(F.lit("retained").alias("order_type"), (F.col("n_rows") - 1).alias("rows"),
                 rest_c.alias("gb_c"), rest_n.cast("bigint").alias("gb_n")),
    )
    return (cdays.select(S.USER, S.DATE, F.inline(parts))
                 .where(F.col("rows") > 0))


# Days with more orders than this are ranked by a range-partitioned sort
# instead of a per-day window (one task per day).
HOT_DAY_ROWS = 1_000_000

_ORDER_COLS = [S.USER, S.ORDER, S.DATE, S.PLATFORM, S.GROSS_USD, S.MARGIN_USD, S.VFM_USD, S.PROFIT_USD, S.STATUS]


def _finish(j: DataFrame, rank_in_day) -> DataFrame:
    is_first = F.col(S.ORDER) == F.col("first_order_uuid")
    return j.select(
        *_ORDER_COLS,
        F.when(is_first, F.col("prev_day")).otherwise(F.col(S.DATE)).alias("prev_order_date"),
        (F.col("orders_before") + rank_in_day).cast("bigint").alias("order_seq"),
        F.when(is_first, F.col("day_type")).otherwise(F.lit("retained")).alias("order_type"),
    )


_DAY_FACTS = ["first_order_uuid", "prev_day", "orders_before", "day_type", "n_rows"]


def _ranked_by_window(orders: DataFrame, cdays: DataFrame) -> DataFrame:
    j = orders.select(*_ORDER_COLS).join(cdays.select(S.USER, S.DATE, *_DAY_FACTS).hint("merge"), [S.USER, S.DATE])
    # the join leaves the rows clustered by (user, date): this window sorts, no shuffle
    w_day = Window.partitionBy(S.USER, S.DATE).orderBy(S.ORDER)
    return _finish(j, F.when(F.col("n_rows") == 1, F.lit(1)).otherwise(F.row_number().over(w_day)))


def with_day_facts(orders: DataFrame, cdays: DataFrame, hot_day_rows: int = HOT_DAY_ROWS) -> DataFrame:
    """M0 rows of ``orders`` (all orders of each of their days) from written classified days.

    Days above ``hot_day_rows`` orders, few by construction, are looked up by a broadcast or, past its
    size bound, by a salted join, and their orders are ranked by :func:`rank_within`, so no task
    holds a whole oversized day whatever the join strategy."""
    hot_days = cdays.where(F.col("n_rows") > hot_day_rows).select(S.USER, S.DATE, *_DAY_FACTS)
    if hot_days.isEmpty():
        return _ranked_by_window(orders, cdays)
    marked = lookup_join(orders.select(*_ORDER_COLS), hot_days, [S.USER, S.DATE], S.ORDER)
    hot = marked.where(F.col("n_rows").isNotNull())
    payload = [c for c in hot.columns if c not in (S.USER, S.DATE, S.ORDER)]
    ranked = rank_within(hot, [S.USER, S.DATE], S.ORDER, "rank_in_day", carry=payload)
    cold = marked.where(F.col("n_rows").isNull())
    return _ranked_by_window(cold, cdays).unionByName(_finish(ranked, F.col("rank_in_day")))


def classify_orders(clean: DataFrame, gap_days: int = S.REACTIVATION_GAP_DAYS,
                    hot_day_rows: int = HOT_DAY_ROWS) -> DataFrame:
    """Order-level classification (M0): the 9 order columns plus
    prev_order_date, order_seq and order_type.

    The day facts are written once (one row per customer and day) and joined back on
    (user, date); the rank inside a day is a per-day window.  A table of at most ``hot_day_rows`` orders
    (a count over Parquet footers) has no oversized day; in a larger one they are looked for and
    go their own way (:func:`with_day_facts`).
    Order ids must be unique, which the critical checks of the cleaned table ensure.
    """
    spark = clean.sparkSession
    path = scratch_path(spark, "day_facts")
    classified_days(clean, gap_days, amounts=False).select(S.USER, S.DATE, *_DAY_FACTS).write.parquet(path)
    cdays = spark.read.parquet(path)
    if clean.count() <= hot_day_rows:
        return _ranked_by_window(clean, cdays)
    return with_day_facts(clean, cdays, hot_day_rows)


def order_gaps(clean: DataFrame) -> DataFrame:
    """W1 + W2: previous order date and sequence number per customer."""
    return classify_orders(clean).select(S.USER, S.ORDER, S.DATE, "prev_order_date", "order_seq")


def classified_audit(clean: DataFrame, gap_days: int = S.REACTIVATION_GAP_DAYS) -> DataFrame:
    """D8: classified orders with the rule version, for tracing a type back to its gap."""
    version = S.CLASSIFICATION_RULE_VERSION if gap_days == S.REACTIVATION_GAP_DAYS else f"gap>{gap_days}d/v1"
    return (classify_orders(clean, gap_days)
            .withColumn("gap_days", F.datediff(S.DATE, "prev_order_date"))
            .withColumn("classification_rule_version", F.lit(version)))


def compare_gaps(clean: DataFrame, gap_a: int, gap_b: int) -> DataFrame:
    """D8: orders per type under two gaps, and the earliest order (date, then id) of
    each type under ``gap_b`` as a worked example.

    Works on the day facts, written once.  The earliest order that opens a day is in
    them; a retained order can also be a later one of its day, so that example is
    looked up among the orders of the first day that has a retained order."""
    spark = clean.sparkSession
    w = Window.partitionBy(S.USER).orderBy(S.DATE)
    path = scratch_path(spark, "gap_days")
    (order_days(clean, amounts=False).withColumn("prev_day", F.lag(S.DATE).over(w))
     .select(S.USER, S.DATE, "n_rows", "first_order_uuid", day_type(gap_a).alias("type_a"),
             day_type(gap_b).alias("type_b")).write.parquet(path))
    days = spark.read.parquet(path)

    def parts(kind: str):
        rest = F.col("n_rows") - 1
        return F.array(F.struct(F.col(kind).alias("order_type"), F.lit(1).cast("bigint").alias("n")),
                       F.struct(F.lit("retained").alias("order_type"), rest.alias("n")))

    def counts(kind: str, name: str) -> DataFrame:
        return (days.select(F.inline(parts(kind))).where("n > 0")
                    .groupBy("order_type").agg(F.sum("n").alias(name)))

    first_retained = days.where((F.col("type_b") == "retained") | (F.col("n_rows") > 1)).agg(F.min(S.DATE)).scalar()
    openers = days.where(F.col("type_b") != "retained")
    sample_open = openers.groupBy(F.col("type_b").alias("order_type")).agg(
        F.min_by(F.col("first_order_uuid"), F.struct(S.DATE, "first_order_uuid")).alias("sample_order_uuid"))
    not_retained = openers.where(F.col(S.DATE) == first_retained).select(F.col("first_order_uuid").alias(S.ORDER))
    sample_retained = (clean.where(F.col(S.DATE) == first_retained).select(S.ORDER)
                       .join(not_retained, S.ORDER, "left_anti")
                       .agg(F.min(S.ORDER).alias("sample_order_uuid"))
                       .select(F.lit("retained").alias("order_type"), "sample_order_uuid"))
    a = counts("type_a", f"orders_gap{gap_a}")
    b = counts("type_b", f"orders_gap{gap_b}").join(sample_open.unionByName(sample_retained), "order_type", "left")
    return a.join(b, "order_type", "full")
