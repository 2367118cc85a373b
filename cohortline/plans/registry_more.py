"""Registered queries of identity linking, run comparison, refreshes, layout and publishing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.operators import dashboard as P
from cohortline.operators import identity as ID
from cohortline.operators import marts as M
from cohortline.operators import quality as Q
from cohortline.operators import snapshots as SN
from cohortline.operators.classify import classify_orders
from cohortline.operators.cleaning import DataQualityError
from cohortline.operators.incremental import State, refresh_classified
from cohortline.plans import oracle as O
from cohortline.plans import oracle_more as OM
from cohortline.plans.registry import cleaned_table, register
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from cohortline.sources import fixture as FX
from cohortline.sources.layout import CustomerLayout

# ── identity linking (D1, D2, D11) ──────────────────────────────────────────

for _name, _overlap in (("identity_clusters", "span"), ("identity_clusters_same_day", "day")):
    register(_name, OM.identity_clusters_sql(_overlap))(
        lambda s, d, o=_overlap: ID.identity_clusters(FX.reissued_ids(cleaned_table(s, d)), o))


@register("identity_excess", OM.identity_excess_sql())
def identity_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = FX.reissued_ids(cleaned_table(spark, sf_dir))
    return ID.identity_excess(orders, ID.identity_clusters(orders))


# ── excess over the last run (D11) ──────────────────────────────────────────

@register("excess_by_cohort_country", OM.excess_by_cell_sql())
def excess_by_cohort_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two persisted runs of the customer table, the second with a planted migration of ids."""
    root = scratch_path(spark, "customer_runs")
    for orders in FX.migrated_runs(cleaned_table(spark, sf_dir)):
        SN.write_snapshot(SN.customer_snapshot(orders), root)
    return SN.compare_last_runs(spark, root)


# ── refresh when further files arrive (M0, M1) ──────────────────────────────

@register("master_customer_refreshed", O.master_customer_sql())
def master_customer_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1 from the state after three refreshes, the last with late dates."""
    state = State(spark, scratch_path(spark, "state"))
    for batch in FX.arriving_batches(cleaned_table(spark, sf_dir)):
        state.refresh(batch)
    return state.master_customer_table()


@register("classified_refreshed", O.classified_orders_sql())
def classified_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M0 of the first file, then kept up to date over two arrivals."""
    first, second, late = FX.arriving_batches(cleaned_table(spark, sf_dir))
    state = State(spark, scratch_path(spark, "state"))
    state.refresh(first)
    known, out = first, classify_orders(first)
    for batch in (second, late):
        path = scratch_path(spark, "classified")
        refresh_classified(state, out, known, batch).write.parquet(path)
        known, out = known.unionByName(batch), spark.read.parquet(path)
    return out


# ── bucketed layout (S2, S5) ────────────────────────────────────────────────

def _layout(orders: DataFrame, hot_rows: int = 1_000_000) -> CustomerLayout:
    spark = orders.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return CustomerLayout.write(orders, f"orders_by_customer_{uuid.uuid4().hex[:12]}", scratch_path(spark, "layout"), buckets, hot_rows)


register("layout_classified", O.classified_hot_day_sql())(
    lambda s, d: _layout(FX.one_large_customer(cleaned_table(s, d)), 1000).classified_orders())
register("layout_master_customer", O.master_customer_sql())(lambda s, d: _layout(cleaned_table(s, d)).master_customer_table())
register("layout_mix_6m", O.revenue_mix_6m_sql())(lambda s, d: _layout(cleaned_table(s, d)).revenue_mix_6m())
register("layout_mix_monthly", O.revenue_mix_monthly_sql())(lambda s, d: _layout(cleaned_table(s, d)).revenue_mix_monthly())


# ── published table (S4, D10) ───────────────────────────────────────────────

ANNOTATION = {"source_tables": "orders_historical,orders_recent", "refresh": "daily 06:00 UTC", "max_lag_hours": "24",
              "data_owner": "analytics"}


def _published(spark: SparkSession, sf_dir: str) -> str:
    """The cleaned table published in two versions with a refused one in between; its name."""
    clean = cleaned_table(spark, sf_dir)
    name, path = f"orders_merged_{uuid.uuid4().hex[:12]}", scratch_path(spark, "published")

    def check(df: DataFrame) -> None:
        Q.raise_on_critical(Q.critical_counts(df))

    IO.publish_table(FX.arriving_batches(clean)[0], name, path, check=check)
    try:
        IO.publish_table(clean.unionByName(clean), name, path, check=check)
    except DataQualityError:
        pass
    IO.publish_table(clean, name, path, "cleaned orders, one row per order", ANNOTATION, check)
    return name


register("published_orders", O.clean_orders_sql())(lambda s, d: IO.read_table(s, _published(s, d)))


@register("published_annotation", OM.annotation_sql(ANNOTATION))
def published_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comment, lineage and owner of the published table, with the rows they describe."""
    name = _published(spark, sf_dir)
    props = IO.table_properties(spark, name)
    pairs = [F.struct(F.lit(k).alias("property"), F.lit(props.get(k)).alias("value")) for k in sorted([*ANNOTATION, "comment"])]
    return spark.table(name).agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(F.array(*pairs)), "row_count")


# ── date bounds (Q18), current date, round bins (P7) ────────────────────────

register("date_bounds_check", OM.date_bounds_sql())(
    lambda s, d: Q.date_bounds_check(cleaned_table(s, d), OM.DATE_BOUNDS[0], OM.DATE_BOUNDS[1]))
register("master_customer_today", OM.master_customer_today_sql())(
    lambda s, d: M.master_customer_table(cleaned_table(s, d), as_of="current_date"))
register("orders_histogram_round", OM.orders_histogram_round_sql())(
    lambda s, d: P.orders_histogram_round(M.master_customer_table(cleaned_table(s, d))))


# ── raw files of any layout (S1) ────────────────────────────────────────────

@register("scan_raw_any_layout", OM.raw_broken_sql())
def scan_raw_any_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both raw files in one folder, the second with its columns in another order, and with line
    breaks, quotes and commas inside a field."""
    path = scratch_path(spark, "raw_folder")
    for name, part in zip(("hist", "recent"), FX.raw_files(spark, sf_dir)):
        part = part.withColumn(S.CITY, F.concat(S.CITY, F.lit('\n"'), S.PLATFORM, F.lit('", x')))
        IO.write_csv(part if name == "hist" else part.select(*reversed(part.columns)), f"{path}/{name}")
    raw = IO.read_raw_csv_any(spark, path)
    return raw.withColumns({c: raw[c].cast("double") for c in S.AMOUNT_COLUMNS})
