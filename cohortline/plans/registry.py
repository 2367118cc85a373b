"""Named end-to-end queries over the star-schema test tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame; the
matching SQL formulation lives in :mod:`cohortline.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.operators import adhoc as A
from cohortline.operators import classify as CL
from cohortline.operators import cleaning as C
from cohortline.operators import dashboard as P
from cohortline.operators import marts as M
from cohortline.operators import quality as Q
from cohortline.operators import trust as D
from cohortline.operators.cleaning import clean_orders
from cohortline.plans import oracle as O
from cohortline.plans.materialize import materialize_clean
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from cohortline.sources.fixture import city_country_lookup, raw_files, raw_orders

Query = Callable[[SparkSession, str], DataFrame]


def cleaned(spark: SparkSession, sf_dir: str, fx_round_digits: int | None = 2) -> DataFrame:
    """Raw fixture -> cleaned 19-column order table (lazy)."""
    return clean_orders(raw_orders(spark, sf_dir), city_country_lookup(spark, sf_dir), fx_round_digits)


def cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned order table as the marts consume it: built once, checked
    (duplicates / null keys raise), written as Parquet under the shared
    checkpoint folder and read back — the application's "save cleaned data,
    then query it" flow.  Rebuilt whenever an input file changes."""
    return materialize_clean(spark, sf_dir, lambda: cleaned(spark, sf_dir))


QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ── marts ───────────────────────────────────────────────────────────────────

register("clean_orders", O.clean_orders_sql())(lambda s, d: cleaned(s, d))
register("cleaned_table", O.clean_orders_sql())(lambda s, d: cleaned_table(s, d))
register("add_usd_exact_rate", O.clean_orders_sql(fx_round=False))(lambda s, d: cleaned(s, d, None))
register("classified_orders", O.classified_orders_sql())(lambda s, d: CL.classify_orders(cleaned_table(s, d)))


@register("classified_hot_day", O.classified_hot_day_sql())
def classified_hot_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M0 with about a third of all orders on one customer's day, ranked by the hot-day path."""
    hot = F.col(S.ORDER).substr(-1, 1).isin("0", "3", "6")
    moved = cleaned_table(spark, sf_dir).withColumns({
        S.USER: F.when(hot, F.lit("HOT")).otherwise(F.col(S.USER)),
        S.DATE: F.when(hot, F.lit("1997-01-01").cast("date")).otherwise(F.col(S.DATE))})
    return CL.classify_orders(moved, hot_day_rows=1000)


register("order_gaps", O.order_gaps_sql())(lambda s, d: CL.order_gaps(cleaned_table(s, d)))
register("master_customer_table", O.master_customer_sql())(
    lambda s, d: M.master_customer_table(cleaned_table(s, d)))
register("master_customer_join", O.master_customer_sql())(
    lambda s, d: M.master_customer_table(cleaned_table(s, d), method="join"))
register("revenue_mix_6m", O.revenue_mix_6m_sql())(lambda s, d: M.revenue_mix_6m(cleaned_table(s, d)))


def unrounded_bookings(clean: DataFrame) -> DataFrame:
    """Cleaned orders whose USD bookings keep all decimals of amount × rate."""
    return clean.withColumn(S.GROSS_USD, F.col(S.GROSS_OP) * F.col(S.FX))


register("revenue_mix_6m_exact", O.revenue_mix_6m_exact_sql())(
    lambda s, d: M.revenue_mix_6m(unrounded_bookings(cleaned(s, d, None)), round_first=False))
register("revenue_mix_monthly", O.revenue_mix_monthly_sql())(lambda s, d: M.revenue_mix_monthly(cleaned_table(s, d)))
register("platform_summary", O.platform_summary_sql())(lambda s, d: M.platform_summary(cleaned_table(s, d)))
register("platform_summary_rounded", O.platform_summary_sql(round_first=True))(
    lambda s, d: M.platform_summary(cleaned_table(s, d), round_first=True))
register("platform_share_yearly", O.platform_share_yearly_sql())(
    lambda s, d: M.platform_share_yearly(cleaned_table(s, d)))


# ── sources and cleaning steps ──────────────────────────────────────────────



def _typed_raw(df: DataFrame) -> DataFrame:
    """Raw text columns with the amounts read as doubles (no rounding)."""
    return df.withColumns({c: df[c].cast("double") for c in S.AMOUNT_COLUMNS})


@register("scan_raw", O.raw_all_sql())
def _scan_raw(spark, sf_dir):
    """S1: the two raw files written as CSV, the second with its columns in another
    order, and scanned back by header name with the all-text schema."""
    hist, recent = raw_files(spark, sf_dir)
    recent = recent.select(*reversed(recent.columns))
    hp, rp = scratch_path(spark, "raw_hist"), scratch_path(spark, "raw_recent")
    IO.write_csv(hist, hp)
    IO.write_csv(recent, rp)
    h, r = IO.load_raw(spark, hp, rp)
    return _typed_raw(C.merge_files(h, r))


@register("csv_round_trip", O.clean_orders_sql())
def _csv_round_trip(spark, sf_dir):
    """S2/S5: cleaned table written as CSV and read back typed ('' and null kept apart)."""
    path = scratch_path(spark, "clean_csv")
    IO.write_clean(cleaned(spark, sf_dir), path, fmt="csv")
    return IO.read_clean(spark, path, fmt="csv")


register("merge_files", O.raw_all_sql())(lambda s, d: C.merge_files(*raw_files(s, d)))
register("fix_date", O.fix_date_sql())(lambda s, d: C.fix_date_column(raw_orders(s, d)))
register("fix_country", O.fix_country_sql())(
    lambda s, d: C.fix_missing_country(raw_orders(s, d), city_country_lookup(s, d)))
def partial_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A city lookup that knows the cities of two regions only."""
    return city_country_lookup(spark, sf_dir).where(F.col("country").isin("ASIA", "EUROPE"))


register("residual_null_country", O.residual_null_country_sql())(
    lambda s, d: C.country_fill_summary(raw_orders(s, d), partial_lookup(s, d)))
register("fix_promo", O.fix_promo_sql())(lambda s, d: C.fix_promo_code(raw_orders(s, d)))
register("standardise_types", O.standardise_types_sql())(lambda s, d: C.standardise_column_types(raw_orders(s, d)))
register("add_usd", O.add_usd_sql())(
    lambda s, d: C.add_usd_columns(C.standardise_column_types(raw_orders(s, d))))
register("country_audit", O.country_audit_sql())(
    lambda s, d: C.country_audit(raw_orders(s, d), city_country_lookup(s, d)))
register("issue_log", O.issue_log_sql())(lambda s, d: C.issue_log(raw_orders(s, d)))

# ── quality rules ───────────────────────────────────────────────────────────

register("check_duplicates", O.check_duplicates_sql())(
    lambda s, d: Q.check_duplicates(C.merge_files(*raw_files(s, d, overlap=True))))
register("file_overlap", O.file_overlap_sql())(lambda s, d: Q.file_overlap(*raw_files(s, d, overlap=True)))
register("check_key_nulls", O.check_key_nulls_sql())(lambda s, d: Q.check_key_nulls(raw_orders(s, d)))
register("null_profile", O.null_profile_sql())(lambda s, d: Q.null_profile(raw_orders(s, d)))
register("quality_report", O.quality_report_sql())(
    lambda s, d: Q.quality_report(cleaned_table(s, d), raw_orders(s, d), boundary="1999-07-01"))
register("distinct_values", O.distinct_values_sql())(lambda s, d: Q.distinct_values(cleaned_table(s, d)))
register("status_distribution", O.status_distribution_sql())(lambda s, d: Q.status_distribution(cleaned_table(s, d)))
# region names stand in for country codes; one value is deliberately left out
FIXTURE_COUNTRY_DOMAIN = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
register("accepted_values", O.accepted_values_sql(FIXTURE_COUNTRY_DOMAIN))(
    lambda s, d: Q.accepted_values(cleaned_table(s, d), S.COUNTRY, FIXTURE_COUNTRY_DOMAIN))
register("refund_rule", O.refund_rule_sql())(lambda s, d: Q.refund_rule(cleaned_table(s, d)))
register("promo_trim_check", O.promo_trim_check_sql())(lambda s, d: Q.promo_trim_check(raw_orders(s, d)))
register("usd_formula_check", O.usd_formula_check_sql())(
    lambda s, d: Q.usd_formula_check(cleaned(s, d, None), rate_digits=2))


@register("type_profile", O.type_profile_sql())
def _type_profile(spark, sf_dir):
    """Q12: what the values of the raw columns read as."""
    return Q.type_profile(raw_orders(spark, sf_dir))


# ── trust checks ────────────────────────────────────────────────────────────

register("uuid_location_orders", O.uuid_location_orders_sql())(lambda s, d: D.uuid_location_orders(cleaned_table(s, d)))
register("uuid_clusters", O.uuid_clusters_sql())(lambda s, d: D.uuid_clusters(cleaned_table(s, d)))
register("grain_check", O.grain_check_sql())(lambda s, d: D.grain_check(cleaned_table(s, d)))
register("redemption_rate", O.redemption_rate_sql())(lambda s, d: D.redemption_rate(cleaned_table(s, d)))
register("row_drift_check", O.row_drift_check_sql())(
    lambda s, d: D.row_drift_check(cleaned_table(s, d), D.literal_frame(s, O.RUN_LOG, "run_id bigint, row_count bigint")))
register("mct_contracts", O.mct_contracts_sql())(lambda s, d: D.mct_contracts(M.master_customer_table(cleaned_table(s, d))))


@register("reconciliation", O.reconciliation_sql())
def _reconciliation(spark, sf_dir):
    c = cleaned_table(spark, sf_dir)
    return D.reconciliation(c, M.master_customer_table(c))


register("classified_audit", O.classified_audit_sql())(lambda s, d: CL.classified_audit(cleaned_table(s, d)))
register("classified_180d", O.classified_180d_sql())(lambda s, d: D.classification_compare(cleaned_table(s, d)))
register("freshness_check", O.freshness_check_sql())(
    lambda s, d: D.freshness_check(cleaned_table(s, d), D.literal_frame(s, [(x,) for x in O.FRESHNESS_AS_OF], "as_of string")))
register("customers_by_cohort_country", O.customers_by_cohort_country_sql())(
    lambda s, d: D.customers_by_cohort_country(cleaned_table(s, d)))
register("cluster_count", O.cluster_count_sql())(lambda s, d: D.cluster_count(cleaned_table(s, d)))
register("activation_floor", O.activation_floor_sql())(
    lambda s, d: D.activation_floor(M.revenue_mix_monthly(cleaned_table(s, d))))
register("platform_by_country", O.platform_by_country_sql())(lambda s, d: D.platform_by_country(cleaned_table(s, d)))
register("platform_by_tenure", O.platform_by_tenure_sql())(lambda s, d: D.platform_by_tenure(cleaned_table(s, d)))

# ── customer mart views and dashboard aggregates ────────────────────────────

register("primary_platform", O.primary_platform_sql())(lambda s, d: M.primary_platform(cleaned_table(s, d)))
register("top_customers", O.top_customers_sql())(lambda s, d: M.top_customers(M.master_customer_table(cleaned_table(s, d))))
register("platform_distribution", O.platform_distribution_sql())(lambda s, d: P.platform_distribution(cleaned_table(s, d)))
register("monthly_orders", O.monthly_orders_sql())(lambda s, d: P.monthly_orders(cleaned_table(s, d)))
register("portfolio_kpis", O.portfolio_kpis_sql())(lambda s, d: P.portfolio_kpis(M.master_customer_table(cleaned_table(s, d))))
register("cohort_by_platform", O.cohort_by_platform_sql())(
    lambda s, d: P.cohort_by_platform(M.master_customer_table(cleaned_table(s, d))))
register("orders_histogram", O.orders_histogram_sql())(
    lambda s, d: P.orders_histogram(M.master_customer_table(cleaned_table(s, d))))
register("orders_histogram_bins", O.orders_histogram_bins_sql())(
    lambda s, d: P.orders_histogram_bins(M.master_customer_table(cleaned_table(s, d))))
register("profitability_points", O.profitability_points_sql())(
    lambda s, d: P.profitability_points(M.master_customer_table(cleaned_table(s, d))))
register("platform_delta", O.platform_delta_sql())(lambda s, d: P.platform_delta(M.platform_summary(cleaned_table(s, d))))
register("platform_metrics_long", O.platform_metrics_long_sql())(
    lambda s, d: P.platform_metrics_long(M.platform_summary(cleaned_table(s, d))))
register("monthly_tail", O.monthly_tail_sql())(
    lambda s, d: A.tail_rows(M.revenue_mix_monthly(cleaned_table(s, d)), 6, "month", "order_type"))

# ── ad-hoc SQL and the example statements ───────────────────────────────────

_EX_SQL = O.examples_sql()
for _name in A.EXAMPLES:
    register(_name, _EX_SQL[_name])(lambda s, d, _n=_name: A.run_example(s, cleaned_table(s, d), _n))
register("ex_order_classification", _EX_SQL["ex_order_classification"])(
    lambda s, d: A.order_classification_example(CL.classify_orders(cleaned_table(s, d))))

from cohortline.plans import registry_more  # noqa: E402,F401  (registers its queries)
