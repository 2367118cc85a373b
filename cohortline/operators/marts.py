"""Marts M1–M5 over the cleaned order table.

Money is aggregated as exact integer cents; ``ROUND(SUM(x), 2)`` is the cent
total / 100 and ``ROUND(AVG(x), 2)`` is one rounded division of the cent total
by the non-null count.  Results are therefore independent of partitioning and
summation order, and identical on any engine that does the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.dates import month_start
from cohortline.functions.money import (cents_to_usd, mean_cents_to_usd, micros_to_usd, pct_1dp, round_half_up,
                                        to_cents, to_micros)
from cohortline.operators.classify import classified_days, day_type, day_type_contributions


def dataset_max_date(clean: DataFrame) -> Column:
    """max(operational_view_date) as a scalar subquery (one partial-aggregated job)."""
    return clean.agg(F.max(S.DATE)).scalar()


def _as_of_column(clean: DataFrame, as_of) -> Column:
    if as_of is None:
        return dataset_max_date(clean)
    if isinstance(as_of, str) and as_of == "current_date":
        return F.current_date()
    return F.lit(as_of).cast("date")


# ── M1 ──────────────────────────────────────────────────────────────────────

def platform_of_counts(counts: DataFrame) -> DataFrame:
    """Most frequent platform per customer from ``(user, platform, n)``."""
    best = F.min(F.struct((-F.col("n")).alias("neg_n"), F.col(S.PLATFORM).isNull().alias("is_null"),
                          F.col(S.PLATFORM).alias("p")))
    return counts.groupBy(S.USER).agg(best.getField("p").alias("primary_platform"))


def primary_platform(clean: DataFrame) -> DataFrame:
    """A15: most frequent platform per customer; ties go to the smaller name,
    a null platform sorts last.  Two partial aggregations, no window."""
    return platform_of_counts(clean.groupBy(S.USER, S.PLATFORM).agg(F.count(F.lit(1)).alias("n")))


def primary_platform_ranked(clean: DataFrame) -> DataFrame:
    """The ROW_NUMBER form of A15 (rank 1 per customer), kept for the join variant."""
    counts = clean.groupBy(S.USER, S.PLATFORM).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(S.USER).orderBy(F.col("n").desc(), F.col(S.PLATFORM).asc_nulls_last())
    return (counts.withColumn("rn", F.row_number().over(w)).where("rn = 1")
                  .select(S.USER, F.col(S.PLATFORM).alias("primary_platform")))


def _customer_facts(clean: DataFrame, gap_days: int, as_of) -> DataFrame:
    """Per-customer facts and primary platform with two shuffles.

    Orders are pre-aggregated to (customer, day, platform) rows; one window per
    customer ordered by (day, platform) finds each day's first row and the
    previous active day (``lag``).  Everything after the window is a
    (customer, platform) then (customer) aggregation on data that is already
    hash-partitioned by customer, so no further exchange is planned.  A window
    group holds at most days × platforms rows, whatever the order volume.
    """
    as_of_col = _as_of_column(clean, as_of)
    dp = clean.groupBy(S.USER, S.DATE, S.PLATFORM).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(S.ORDER).alias("n_orders"),
        F.sum(to_cents(S.GROSS_USD)).alias("gb_c"), F.count(S.GROSS_USD).alias("gb_n"),
        F.sum(to_cents(S.MARGIN_USD)).alias("m1_c"), F.sum(to_cents(S.VFM_USD)).alias("vfm_c"),
        F.sum(to_cents(S.PROFIT_USD)).alias("gp_c"), F.count(S.PROFIT_USD).alias("gp_n"),
    )
    w = Window.partitionBy(S.USER).orderBy(S.DATE, F.col(S.PLATFORM).asc_nulls_last())
    prev = F.lag(S.DATE).over(w)
    dp = dp.withColumn("_prev", prev)
    reactivated = (F.col("_prev").isNotNull() & (F.col("_prev") != F.col(S.DATE))
                   & (F.datediff(F.col(S.DATE), F.col("_prev")) > F.lit(gap_days)))
    per_platform = dp.groupBy(S.USER, S.PLATFORM).agg(
        F.min(S.DATE).alias("first_d"), F.max(S.DATE).alias("last_d"),
        F.sum("n_rows").alias("n_rows"), F.sum("n_orders").alias("n_orders"),
        *[F.sum(c).alias(c) for c in ["gb_c", "gb_n", "m1_c", "vfm_c", "gp_c", "gp_n"]],
        F.count_if(reactivated).alias("react"),
    )
    best = F.min(F.struct((-F.col("n_rows")).alias("neg_n"), F.col(S.PLATFORM).isNull().alias("is_null"),
                          F.col(S.PLATFORM).alias("p")))
    agg = per_platform.groupBy(S.USER).agg(
        F.min("first_d").alias("first_order_date"), F.max("last_d").alias("last_order_date"),
        F.sum("n_orders").alias("total_orders"),
        *[F.sum(c).alias(c) for c in ["gb_c", "gb_n", "m1_c", "vfm_c", "gp_c", "gp_n"]],
        F.sum("react").alias("reactivation_count"),
        best.getField("p").alias("primary_platform"),
    )
    return agg.select(
        S.USER, "first_order_date", "last_order_date",
        month_start("first_order_date").alias("acquisition_cohort"),
        "total_orders",
        cents_to_usd("gb_c").alias("total_gross_bookings_usd"),
        mean_cents_to_usd("gb_c", "gb_n").alias("avg_order_value_usd"),
        cents_to_usd("m1_c").alias("total_margin_1_usd"),
        cents_to_usd("vfm_c").alias("total_vfm_usd"),
        cents_to_usd("gp_c").alias("total_gross_profit_usd"),
        mean_cents_to_usd("gp_c", "gp_n").alias("avg_gross_profit_per_order_usd"),
        F.datediff(as_of_col, F.col("last_order_date")).alias("days_since_last_order"),
        "reactivation_count", "primary_platform",
    )


def customer_facts_of_days(cdays: DataFrame, platforms: DataFrame, as_of) -> DataFrame:
    """Customer facts from classified days (day grain with amounts), plus ``platforms``
    (user, primary_platform); the day table's last day stands for a missing ``as_of``."""
    agg = cdays.groupBy(S.USER).agg(
        F.min(S.DATE).alias("first_order_date"), F.max(S.DATE).alias("last_order_date"),
        F.sum("n_orders").alias("total_orders"),
        *[F.sum(c).alias(c) for c in ["gb_c", "gb_n", "m1_c", "vfm_c", "gp_c", "gp_n"]],
        F.count_if(F.col("day_type") == "reactivated").alias("reactivation_count"),
    )
    facts = agg.select(
        S.USER, "first_order_date", "last_order_date",
        month_start("first_order_date").alias("acquisition_cohort"),
        "total_orders",
        cents_to_usd("gb_c").alias("total_gross_bookings_usd"),
        mean_cents_to_usd("gb_c", "gb_n").alias("avg_order_value_usd"),
        cents_to_usd("m1_c").alias("total_margin_1_usd"),
        cents_to_usd("vfm_c").alias("total_vfm_usd"),
        cents_to_usd("gp_c").alias("total_gross_profit_usd"),
        mean_cents_to_usd("gp_c", "gp_n").alias("avg_gross_profit_per_order_usd"),
        F.datediff(_as_of_column(cdays, as_of), F.col("last_order_date")).alias("days_since_last_order"),
        "reactivation_count",
    )
    return facts.join(platforms.hint("merge"), S.USER, "left")      # a row per customer: never broadcast


MASTER_COLUMNS = [
    S.USER, "first_order_date", "last_order_date", "acquisition_cohort", "total_orders",
    "total_gross_bookings_usd", "avg_order_value_usd", "total_margin_1_usd", "total_vfm_usd",
    "total_gross_profit_usd", "avg_gross_profit_per_order_usd", "days_since_last_order",
    "reactivation_count", "primary_platform",
]


def master_customer_table(clean: DataFrame, as_of=None, gap_days: int = S.REACTIVATION_GAP_DAYS,
                          method: str = "aggregate", cdays: DataFrame | None = None) -> DataFrame:
    """M1: one row per customer, 14 columns.

    ``as_of``: None = dataset max date (reproducible), "current_date", or a date.
    ``cdays``: classified days (``classify.classified_days``) shared with other
    marts; the customer facts are then sums over those days.
    ``method``: "aggregate" picks the primary platform with a struct-min
    aggregate in the same pass (two shuffles in total); "join" keeps the
    source's shape — ROW_NUMBER ranking + LEFT JOIN on rank 1 — where both
    join sides are customer-grain aggregates hash-partitioned by user_uuid.
    """
    if cdays is not None:  # classified days computed once for several marts
        return customer_facts_of_days(cdays, primary_platform(clean), as_of).select(*MASTER_COLUMNS)
    facts = _customer_facts(clean, gap_days, as_of)
    if method == "aggregate":
        return facts.select(*MASTER_COLUMNS)
    if method == "join":
        plat = primary_platform_ranked(clean)
        return facts.drop("primary_platform").join(plat, S.USER, "left").select(*MASTER_COLUMNS)
    raise ValueError("method must be 'aggregate' or 'join'")


def top_customers(mct: DataFrame, n: int | None = None) -> DataFrame:
    """O1: mart ordered by total bookings (desc), user id as tie-break."""
    out = mct.orderBy(F.col("total_gross_bookings_usd").desc_nulls_last(), F.col(S.USER))
    return out.limit(n) if n else out


# ── M2 / M3 ─────────────────────────────────────────────────────────────────

def _days_after(clean: DataFrame, cutoff: Column, gap_days: int, unit) -> DataFrame:
    """Classified days after ``cutoff``.  Of the history before it only each
    customer's last active day matters, so that part is one date per customer."""
    d = F.col(S.DATE)
    history = (clean.where(d <= cutoff).groupBy(S.USER).agg(F.max(S.DATE).alias(S.DATE))
                    .withColumn("n_rows", F.lit(0).cast("bigint")))
    amount = unit(S.GROSS_USD)
    days = clean.where(d > cutoff).groupBy(S.USER, S.DATE).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(amount).alias("gb_c"), F.count(S.GROSS_USD).alias("gb_n"),
        F.min_by(amount, F.col(S.ORDER)).alias("first_gb_c"))
    every = days.unionByName(history, allowMissingColumns=True)
    prev = F.lag(S.DATE).over(Window.partitionBy(S.USER).orderBy(S.DATE))
    return (every.withColumn("prev_day", prev).where("n_rows > 0")
                 .withColumn("day_type", day_type(gap_days)))


def revenue_mix_6m(clean: DataFrame, months: int = 6, round_first: bool = True,
                   gap_days: int = S.REACTIVATION_GAP_DAYS, cdays: DataFrame | None = None) -> DataFrame:
    """M2/M2b: bookings by order type for dates strictly after max − ``months``.

    History decides an order's type, so each customer's last day before the cutoff
    takes part in the per-customer window.  ``round_first`` takes the amounts as
    cents (M2); without it they are summed unrounded, in exact millionths, and the
    share comes from those sums (M2b).  ``cdays`` (cent amounts) serves M2 only.
    """
    if cdays is not None and not round_first:
        raise ValueError("classified days hold cents; the unrounded mix starts from the orders")
    cutoff = F.add_months(dataset_max_date(clean), -months)  # one-column scan
    if cdays is None:
        recent = _days_after(clean, cutoff, gap_days, to_cents if round_first else to_micros)
    else:
        recent = cdays.where(F.col(S.DATE) > cutoff)
    by_type = (day_type_contributions(recent).groupBy("order_type")
               .agg(F.sum(F.col("gb_c").cast("decimal(28,0)")).alias("gb_c")))
    total = F.sum("gb_c").over(Window.partitionBy())  # ≤ 3 rows
    usd = cents_to_usd("gb_c") if round_first else micros_to_usd("gb_c")
    return (by_type.select("order_type", usd.alias(S.GROSS_USD), pct_1dp(F.col("gb_c"), total).alias("pct_share"))
                   .orderBy(F.col("pct_share").desc_nulls_last(), "order_type"))


def revenue_mix_monthly(clean: DataFrame, gap_days: int = S.REACTIVATION_GAP_DAYS,
                        cdays: DataFrame | None = None) -> DataFrame:
    """M3: bookings and share by (month, order type) over the full history."""
    parts = day_type_contributions(cdays if cdays is not None else classified_days(clean, gap_days))
    by = (parts.groupBy(month_start(S.DATE).alias("month"), "order_type")
               .agg(F.sum("gb_c").alias("gb_c")))
    total = F.sum("gb_c").over(Window.partitionBy("month"))
    return (by.select("month", "order_type", cents_to_usd("gb_c").alias(S.GROSS_USD),
                      pct_1dp(F.col("gb_c"), total).alias("pct_share"))
              .orderBy("month", "order_type"))


# ── M4 / M5 ─────────────────────────────────────────────────────────────────

def platform_group(col: str = S.PLATFORM) -> Column:
    """touch is mobile web: grouped with web."""
    return F.when(F.col(col) == "touch", F.lit("web")).otherwise(F.col(col))


def customer_platform(clean: DataFrame, extra_keys: list | None = None) -> DataFrame:
    """Per (customer, platform group[, extra keys]): orders, cent sums, non-null counts."""
    keys = [F.col(S.USER), platform_group().alias("platform_group")] + list(extra_keys or [])
    return clean.groupBy(*keys).agg(
        F.count(S.ORDER).alias("orders"),
        F.sum(to_cents(S.GROSS_USD)).alias("gb_c"), F.count(S.GROSS_USD).alias("gb_n"),
        F.sum(to_cents(S.PROFIT_USD)).alias("gp_c"),
    )


# A customer's mean order value is kept in this fraction of a cent, as an integer.
MEAN_UNITS_PER_CENT = 1_000_000


def _platform_metrics(cp: DataFrame, keys: list[str], round_first: bool) -> DataFrame:
    """All sums run over integers (``decimal(38,0)``), so their order does not matter."""
    unit = 1 if round_first else MEAN_UNITS_PER_CENT   # round_first: whole cents per customer
    wide = "decimal(19,0)"
    mean = F.round(F.try_divide(F.col("gb_c").cast("double") * F.lit(float(unit)), F.col("gb_n").cast("double")))
    aov = mean.cast(wide)
    booked = F.col("orders").cast(wide) * aov
    if not round_first:
        # orders × mean = the customer's cent total whenever no amount is null
        booked = F.when(F.col("gb_n") == F.col("orders"), F.col("gb_c").cast(wide) * F.lit(unit).cast(wide)) \
                  .otherwise(booked)
    per = cp.select(*keys, S.USER, "orders", aov.alias("aov"), F.col("gp_c"), booked.alias("booked"))
    agg = per.groupBy(*keys).agg(
        F.count(S.USER).alias("unique_customers"),  # (customer, group) rows are unique
        F.sum("orders").alias("orders_sum"), F.count("orders").alias("orders_n"),
        F.sum("aov").alias("aov_sum"), F.count("aov").alias("aov_n"),
        F.sum(F.col("gp_c").cast("decimal(28,0)")).alias("gp_sum"), F.count("gp_c").alias("gp_n"),
        F.sum("booked").alias("booked"),
    )
    return agg.select(
        *keys, "unique_customers",
        round_half_up(F.try_divide(F.col("orders_sum").cast("double"), F.col("orders_n").cast("double")))
        .alias("avg_orders_per_customer"),
        (F.round(F.try_divide(F.col("aov_sum").cast("double"), F.col("aov_n").cast("double") * float(unit))) / 100.0)
        .alias("avg_order_value_usd"),
        mean_cents_to_usd("gp_sum", "gp_n").alias("avg_gross_profit_per_customer_usd"),
        (F.round(F.col("booked").cast("double") / float(unit)) / 100.0).alias("total_gross_bookings_usd"),
    )


def platform_summary(clean: DataFrame, round_first: bool = False) -> DataFrame:
    """M4 (round_first=False) / M4b (True): customer-level app vs web metrics.
    A customer active on both groups counts in both; AOV is a mean of
    per-customer means."""
    return _platform_metrics(customer_platform(clean), ["platform_group"], round_first).orderBy("platform_group")


def platform_share_yearly(clean: DataFrame) -> DataFrame:
    """M5: bookings and share per (year, platform group)."""
    by = (clean.groupBy(F.year(S.DATE).alias("year"), platform_group().alias("platform_group"))
               .agg(F.sum(to_cents(S.GROSS_USD)).alias("gb_c")))
    total = F.sum("gb_c").over(Window.partitionBy("year"))
    return (by.select("year", "platform_group", cents_to_usd("gb_c").alias(S.GROSS_USD),
                      pct_1dp(F.col("gb_c"), total).alias("pct_share"))
              .orderBy("year", "platform_group"))
