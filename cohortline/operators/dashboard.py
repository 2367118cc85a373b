"""Aggregates behind the dashboard tiles and charts (P1–P10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.dates import month_start
from cohortline.functions.money import cents_to_usd, to_cents

PLATFORM_METRICS = ["unique_customers", "avg_orders_per_customer", "avg_order_value_usd",
                    "avg_gross_profit_per_customer_usd", "total_gross_bookings_usd"]


def platform_distribution(clean: DataFrame) -> DataFrame:
    return (clean.groupBy(S.PLATFORM).agg(F.count(F.lit(1)).alias("orders"))
                 .orderBy(F.col("orders").desc(), S.PLATFORM))


def monthly_orders(clean: DataFrame) -> DataFrame:
    return (clean.groupBy(month_start(S.DATE).alias("month")).agg(F.count(F.lit(1)).alias("orders"))
                 .orderBy("month"))


def portfolio_kpis(mct: DataFrame) -> DataFrame:
    """Customers, Σ bookings, Σ profit (exact cents) and mean orders per customer."""
    return mct.agg(
        F.count(F.lit(1)).alias("customers"),
        cents_to_usd(F.sum(to_cents("total_gross_bookings_usd"))).alias("total_gross_bookings_usd"),
        cents_to_usd(F.sum(to_cents("total_gross_profit_usd"))).alias("total_gross_profit_usd"),
        F.try_divide(F.sum("total_orders").cast("double"), F.count("total_orders").cast("double"))
         .alias("avg_orders_per_customer"),
    )


def cohort_by_platform(mct: DataFrame) -> DataFrame:
    return (mct.groupBy(F.year("acquisition_cohort").alias("cohort_year"), "primary_platform")
               .agg(F.count(F.lit(1)).alias("customers"))
               .orderBy("cohort_year", "primary_platform"))


def orders_histogram(mct: DataFrame) -> DataFrame:
    """Exact frequency of customers by total order count."""
    return (mct.groupBy("total_orders").agg(F.count(F.lit(1)).alias("customers"))
               .orderBy("total_orders"))


def orders_histogram_bins(mct: DataFrame, bins: int = 12) -> DataFrame:
    """Equal-width bins over [min, max] of total_orders, from its exact frequencies
    (one row per different order count)."""
    freq = mct.groupBy("total_orders").agg(F.count(F.lit(1)).alias("customers"))
    every = Window.partitionBy()  # over the frequencies, not the customers
    n = F.col("total_orders")
    b = F.width_bucket(n, F.min(n).over(every), F.max(n).over(every) + 1, F.lit(bins))
    return (freq.withColumn("bin", b).groupBy("bin")
                .agg(F.sum("customers").alias("customers"), F.min(n).alias("min_orders"),
                     F.max(n).alias("max_orders")).orderBy("bin"))


def orders_histogram_round(mct: DataFrame, most_bins: int = 12) -> DataFrame:
    """Bins of a round width, the chart's own kind: the least of 1, 2 and 5 times a power of ten that
    needs at most ``most_bins`` bins with edges at multiples of it.

    ``bin_start`` (included), ``bin_end`` (excluded), ``customers``; empty bins in between are listed.  Works on
    the exact frequencies, one row per different order count."""
    freq = orders_histogram(mct).where(F.col("total_orders").isNotNull())
    widths = F.array(*[F.lit(m * 10 ** k).cast("bigint") for k in range(18) for m in (1, 2, 5)])
    lo, hi = F.min("total_orders"), F.max("total_orders")
    span = freq.agg(lo.alias("lo"), hi.alias("hi")).where(F.col("lo").isNotNull())
    place = lambda x, w: F.floor(x / w)
    chosen = span.withColumn("w", F.filter(widths, lambda w: place(F.col("hi"), w) - place(F.col("lo"), w) < most_bins)[0])
    # one row of bounds, at most ``most_bins`` bins
    bins = chosen.select("w", F.explode(F.sequence(place(F.col("lo"), F.col("w")), place(F.col("hi"), F.col("w")))).alias("b")).select(
        (F.col("b") * F.col("w")).alias("bin_start"), ((F.col("b") + 1) * F.col("w")).alias("bin_end"))
    inside = (F.col("total_orders") >= F.col("bin_start")) & (F.col("total_orders") < F.col("bin_end"))
    return (freq.join(F.broadcast(bins), inside, "right").groupBy("bin_start", "bin_end")
            .agg(F.coalesce(F.sum("customers"), F.lit(0)).alias("customers")).orderBy("bin_start"))


def profitability_points(mct: DataFrame) -> DataFrame:
    return mct.select(S.USER, "total_gross_bookings_usd", "total_gross_profit_usd", "total_orders",
                      "primary_platform", "reactivation_count")


def platform_delta(summary: DataFrame, a: str = "app", b: str = "web") -> DataFrame:
    """``a`` minus ``b`` for AOV, orders per customer and profit per customer."""
    def pick(metric: str, grp: str):
        return F.max(F.when(F.col("platform_group") == grp, F.col(metric)))

    deltas = [(pick(m, a) - pick(m, b)).alias(f"{m}_delta") for m in
              ["avg_order_value_usd", "avg_orders_per_customer", "avg_gross_profit_per_customer_usd"]]
    return summary.agg(*deltas)


def platform_metrics_long(summary: DataFrame) -> DataFrame:
    """Wide platform summary -> (platform_group, metric, value)."""
    wide = summary.select("platform_group", *[F.col(m).cast("double").alias(m) for m in PLATFORM_METRICS])
    return wide.unpivot(["platform_group"], PLATFORM_METRICS, "metric", "value")
