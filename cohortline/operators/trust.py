"""Model-trust checks (D1–D13): identity, grain, contracts, reconciliation,
drift, freshness and diagnostic breakdowns."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.money import pct_1dp, to_cents
from cohortline.operators.classify import compare_gaps
from cohortline.operators.cleaning import DataQualityError
from cohortline.operators.marts import _platform_metrics, customer_platform


# ── D1–D3 ───────────────────────────────────────────────────────────────────

def uuid_location_orders(df: DataFrame) -> DataFrame:
    """Orders per (user, city, country)."""
    return (df.groupBy(S.USER, S.CITY, S.COUNTRY).agg(F.count(F.lit(1)).alias("orders"))
              .where("orders >= 1").orderBy(S.CITY, S.COUNTRY, S.USER))


def uuid_clusters(df: DataFrame) -> DataFrame:
    """Locations shared by more than one user id, with first/last activity."""
    return (df.groupBy(S.CITY, S.COUNTRY)
              .agg(F.count_distinct(S.USER).alias("uuid_count"),
                   F.min(S.DATE).alias("first_seen"), F.max(S.DATE).alias("last_seen"))
              .where("uuid_count > 1").orderBy(F.col("uuid_count").desc(), S.CITY, S.COUNTRY))


def grain_check(df: DataFrame, key: str = S.USER) -> DataFrame:
    """Keys with more than one row (empty when the table is at ``key`` grain)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


# ── D4 ──────────────────────────────────────────────────────────────────────

def redemption_rate(df: DataFrame) -> DataFrame:
    """Customers overall vs customers with at least one redeemed order."""
    per_user = (df.where(F.col(S.USER).isNotNull()).groupBy(S.USER)
                  .agg(F.bool_or(F.coalesce(F.col(S.STATUS) == "redeemed", F.lit(False))).alias("redeemed")))
    agg = per_user.agg(F.count(F.lit(1)).alias("all_customers"),
                       F.count_if("redeemed").alias("customers_with_redemption"))
    share = F.try_divide(F.col("customers_with_redemption") * F.lit(100.0), F.col("all_customers").cast("double"))
    return agg.select("*", share.alias("redemption_share"),
                      pct_1dp(F.col("customers_with_redemption"), F.col("all_customers")).alias("redemption_pct"))


# ── D5 ──────────────────────────────────────────────────────────────────────

RUN_LOG_SCHEMA = "run_id bigint, row_count bigint"


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """The persisted (run_id, row_count) log; empty where no run has written one."""
    from cohortline.plans.materialize import path_exists

    return spark.read.schema(RUN_LOG_SCHEMA).parquet(path) if path_exists(spark, path) \
        else spark.createDataFrame([], RUN_LOG_SCHEMA)


def _change_pct(count: Column, previous: Column) -> Column:
    return F.try_divide((count - previous) * F.lit(100.0), previous.cast("double"))


def assert_drift_and_log(current: DataFrame, path: str, tolerance_pct: float = 5.0, rows: int | None = None) -> int:
    """Compare the row count with the last logged run's, raise if it moved more than
    ``tolerance_pct``, else log it under the next run id (returned).  A refused run is
    not logged: the next one is held against the last accepted run.  ``rows`` is the count where it is known
    already (observed while the table was read); a refusal counts again."""
    spark = current.sparkSession
    log = read_run_log(spark, path)
    last = log.orderBy(F.col("run_id").desc()).limit(1).select("run_id", "row_count").first()
    run_id = 1 if last is None else last["run_id"] + 1

    def drifted(n: int) -> bool:
        moved = abs(n - last["row_count"]) * 100.0
        return (moved > tolerance_pct * last["row_count"]) if last["row_count"] else n > 0

    n = current.count() if rows is None else rows
    if last is not None and drifted(n):
        n = current.count()
        if drifted(n):
            raise DataQualityError(f"row count drift: {last['row_count']} rows in run {last['run_id']}, now {n}")
    spark.createDataFrame([(run_id, n)], RUN_LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return run_id


def row_drift_check(current: DataFrame, run_log: DataFrame, tolerance_pct: float = 5.0) -> DataFrame:
    """This run's row count after those of a (run_id, row_count) log, with the runs
    flagged whose count moved more than ``tolerance_pct`` against the run before.
    Run ids follow each other without gaps, as ``assert_drift_and_log`` gives them."""
    next_id = run_log.agg(F.coalesce(F.max("run_id"), F.lit(0)) + 1).scalar()
    this_run = current.agg(F.count(F.lit(1)).alias("row_count")).select(next_id.cast("bigint").alias("run_id"),
                                                                       "row_count")
    runs = run_log.select(F.col("run_id").cast("bigint"), F.col("row_count").cast("bigint")).unionByName(this_run)
    before = runs.select((F.col("run_id") + 1).alias("run_id"), F.col("row_count").alias("prev_row_count"))
    change = _change_pct(F.col("row_count"), F.col("prev_row_count"))
    return (runs.join(before, "run_id", "left")
                .withColumn("change_pct", F.round(change * 10) / 10)
                .withColumn("within_tolerance",
                            F.coalesce(F.abs(change) <= F.lit(tolerance_pct), F.lit(True))))


# ── D6 / D7 ─────────────────────────────────────────────────────────────────

def mct_contracts(mct: DataFrame) -> DataFrame:
    """(contract, violations) for the customer table's column contracts."""
    wide = mct.agg(
        (F.count(F.lit(1)) - F.count_distinct(S.USER)).alias("user_uuid_unique"),
        F.count_if(F.col(S.USER).isNull()).alias("user_uuid_not_null"),
        F.count_if(~(F.col("first_order_date") <= F.col("last_order_date"))).alias("first_le_last"),
        F.count_if(~(F.col("total_orders") >= 1)).alias("orders_at_least_1"),
        F.count_if(~(F.col("reactivation_count") <= F.col("total_orders") - 1)).alias("reactivations_le_orders_minus_1"),
    )
    names = wide.columns
    return wide.unpivot([], names, "contract", "violations")


CUSTOMER_RULES = ["user_uuid_not_null", "first_le_last", "orders_at_least_1", "reactivations_le_orders_minus_1"]


def order_totals() -> list[Column]:
    """Aggregates to observe while the orders are read: rows, cents, last day."""
    return [F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum(to_cents(S.GROSS_USD)), F.lit(0)).alias("cents"),
            F.max(S.DATE).alias("last_day")]


def customer_totals() -> list[Column]:
    """Aggregates to observe while the customer table is written: cents and violations per row rule."""
    rules = (F.col(S.USER).isNull(), ~(F.col("first_order_date") <= F.col("last_order_date")), ~(F.col("total_orders") >= 1),
             ~(F.col("reactivation_count") <= F.col("total_orders") - 1))
    return [F.coalesce(F.sum(to_cents("total_gross_bookings_usd")), F.lit(0)).alias("cents"),
            *[F.count_if(r).alias(n) for n, r in zip(CUSTOMER_RULES, rules)]]


def is_fresh(last_day: dt.date | None, as_of: str, max_lag_days: int = 1) -> bool:
    return last_day is not None and (dt.date.fromisoformat(as_of) - last_day).days <= max_lag_days


def assert_contracts(mct: DataFrame) -> None:
    bad = [r for r in mct_contracts(mct).collect() if r["violations"]]
    if bad:
        raise DataQualityError("contract violations: " + ", ".join(f"{r['contract']}={r['violations']}" for r in bad))


def reconciliation(clean: DataFrame, mct: DataFrame) -> DataFrame:
    """Σ order bookings vs Σ customer-table bookings, both in exact cents."""
    raw_c = clean.agg(F.sum(to_cents(S.GROSS_USD))).scalar()
    model_c = mct.agg(F.sum(to_cents("total_gross_bookings_usd"))).scalar()
    one = clean.sparkSession.range(1)
    return one.select((raw_c.cast("double") / 100).alias("raw_total"),
                      (model_c.cast("double") / 100).alias("model_total"),
                      ((raw_c - model_c).cast("double") / 100).alias("difference"))


def assert_reconciled(clean: DataFrame, mct: DataFrame) -> None:
    row = reconciliation(clean, mct).first()
    if row["difference"]:
        raise DataQualityError(f"the customer table holds {row['model_total']} USD, the orders {row['raw_total']}")


def assert_grain(df: DataFrame, key: str = S.USER) -> None:
    row = grain_check(df, key).first()
    if row is not None:
        raise DataQualityError(f"{key} {row[key]!r} has {row['row_count']} rows, one expected")


# ── D8 ──────────────────────────────────────────────────────────────────────

def classification_compare(clean: DataFrame, gap_a: int = S.REACTIVATION_GAP_DAYS, gap_b: int = 180) -> DataFrame:
    """Orders per type under two reactivation gaps, and a sample order under ``gap_b``."""
    return compare_gaps(clean, gap_a, gap_b)


# ── D9 ──────────────────────────────────────────────────────────────────────

def freshness_check(clean: DataFrame, as_of: DataFrame, max_lag_days: int = 1) -> DataFrame:
    """Lag of the newest order date behind each ``as_of`` date (column as_of)."""
    latest = clean.agg(F.max(S.DATE)).scalar()
    lag = F.datediff(F.col("as_of"), latest)
    return as_of.select(F.col("as_of").cast("date").alias("as_of"), latest.alias("max_order_date"),
                        lag.alias("lag_days"), (lag <= F.lit(max_lag_days)).alias("is_fresh"))


def assert_fresh(clean: DataFrame, as_of: str, max_lag_days: int = 1) -> None:
    row = freshness_check(clean, literal_frame(clean.sparkSession, [(as_of,)], "as_of string"), max_lag_days).first()
    if not row["is_fresh"]:
        raise DataQualityError(f"newest order of {row['max_order_date']} is {row['lag_days']} days behind {as_of}")


# ── D11 ─────────────────────────────────────────────────────────────────────

def first_order_facts(clean: DataFrame) -> DataFrame:
    """Per customer: first date and the city/country of the first order
    (by date, then order id) — one partial-aggregated pass."""
    first = F.min(F.struct(S.DATE, S.ORDER, S.CITY, S.COUNTRY))
    return clean.groupBy(S.USER).agg(first.alias("f")).select(
        S.USER, F.col("f")[S.DATE].alias("first_order_date"),
        F.col("f")[S.CITY].alias("first_city"), F.col("f")[S.COUNTRY].alias("first_country"))


def customers_by_cohort_country(clean: DataFrame) -> DataFrame:
    f = first_order_facts(clean)
    return (f.groupBy(F.trunc("first_order_date", "month").alias("acquisition_cohort"),
                      F.col("first_country").alias(S.COUNTRY))
             .agg(F.count(F.lit(1)).alias("customers"))
             .orderBy("acquisition_cohort", S.COUNTRY))


def cluster_count(clean: DataFrame) -> DataFrame:
    """User ids vs distinct (first city, first country, first date) clusters."""
    f = first_order_facts(clean)
    return f.agg(F.count(S.USER).alias("uuid_count"),      # one row per id already
                 F.count_distinct(F.struct("first_city", "first_country", "first_order_date")).alias("cluster_count"))


# ── D12 ─────────────────────────────────────────────────────────────────────

def activation_floor(monthly_mix: DataFrame, floor_pct: float = 10.0) -> DataFrame:
    """Per month, share of bookings from new customers and whether it is under the floor."""
    new_share = F.coalesce(F.max(F.when(F.col("order_type") == "new", F.col("pct_share"))), F.lit(0.0))
    return (monthly_mix.groupBy("month").agg(new_share.alias("new_share_pct"))
            .withColumn("below_floor", F.col("new_share_pct") < F.lit(floor_pct))
            .orderBy("month"))


# ── D13 ─────────────────────────────────────────────────────────────────────

def platform_by_country(clean: DataFrame) -> DataFrame:
    cp = customer_platform(clean, [F.col(S.COUNTRY)])
    return _platform_metrics(cp, ["platform_group", S.COUNTRY], False).orderBy("platform_group", S.COUNTRY)


def platform_by_tenure(clean: DataFrame) -> DataFrame:
    """Platform metrics by tenure year (whole 365-day years since the customer's first order).

    Works on the (customer, day, platform group) grain: the first-order date is
    a window over a customer's active days (bounded by the calendar), so no
    order-level join on the customer key is needed."""
    days = customer_platform(clean, [F.col(S.DATE)])
    first = F.min(S.DATE).over(Window.partitionBy(S.USER))
    tenure = F.floor(F.datediff(F.col(S.DATE), first) / 365)
    cp = (days.withColumn("tenure_year", tenure)
              .groupBy(S.USER, "platform_group", "tenure_year")
              .agg(F.sum("orders").alias("orders"), F.sum("gb_c").alias("gb_c"),
                   F.sum("gb_n").alias("gb_n"), F.sum("gp_c").alias("gp_c")))
    return _platform_metrics(cp, ["platform_group", "tenure_year"], False).orderBy("platform_group", "tenure_year")


def literal_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
