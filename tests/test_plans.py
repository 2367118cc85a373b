"""Plan-shape regressions: the scale properties argued in the README."""

import re

from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions import joins as J
from cohortline.operators import classify as CL
from cohortline.operators import components as CO
from cohortline.operators import identity as ID
from cohortline.operators import marts as M
from cohortline.operators.incremental import State, refresh_classified
from cohortline.plans.registry import cleaned_table
from cohortline.session import scratch_path
from cohortline.sources.fixture import raw_orders
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scan_schemas(plan: str) -> list[str]:
    return re.findall(r"ReadSchema: (struct<[^>]*>)", plan)


def test_master_table_two_shuffles_no_join(spark):
    plan = _plan(M.master_customer_table(cleaned_table(spark, SF_SMALL)))
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Join" not in plan.replace("BroadcastExchange", "")
    assert plan.count("Window [") == 1


def test_classification_window_runs_on_day_grain(spark):
    clean = cleaned_table(spark, SF_SMALL)
    assert "lag(" not in _plan(CL.classify_orders(clean))   # M0 reads the day facts that were written once
    plan = _plan(CL.classified_days(clean))
    # the only per-customer window is the lag over days, fed by the day aggregate
    windows = [line for line in plan.splitlines() if "Window [" in line]
    per_customer = [w for w in windows if "lag(" in w]
    assert len(per_customer) == 1
    assert re.search(r"Aggregate.*keys=\[user_uuid#\d+, operational_view_date#\d+\]", plan) or \
        re.search(r"Aggregate\(key=\[user_uuid#\d+, operational_view_date#\d+\]", plan)


def test_platform_marts_skip_classification_and_prune_columns(spark):
    clean = cleaned_table(spark, SF_SMALL)
    for df in (M.platform_summary(clean), M.platform_share_yearly(clean)):
        plan = _plan(df)
        assert "Window [lag" not in plan
        for schema in _scan_schemas(plan):
            assert "customer_city" not in schema and "incentive_promo_code" not in schema
    assert "partial_sum" in _plan(M.platform_summary(clean))


def test_date_slice_filter_reaches_the_scan(spark):
    plan = _plan(raw_orders(spark, SF_SMALL, "historical"))
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(o_orderdate", plan)


def test_large_lookups_are_merged_not_broadcast(spark, monkeypatch):
    """Lookups past the broadcast bound never reach the driver, however small Spark takes their files for."""
    monkeypatch.setattr(J, "MAX_BROADCAST_ROWS", 10)
    lookup = spark.range(50).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    rows = spark.range(200).select((F.col("id") % 60).alias("k"), F.col("id").alias("n"))
    for spread in ("n", None):
        got = J.lookup_join(rows, lookup, "k", spread)
        assert "BroadcastHashJoin" not in _plan(got)
        assert got.count() == 200 and got.where("v IS NULL").count() == sum(i % 60 >= 50 for i in range(200))
    hooks = spark.range(50).select(F.col("id"), F.lit(0).cast("bigint").alias("to"))
    assert "BroadcastHashJoin" not in _plan(CO._looked_up(rows, "k", hooks))


def test_refreshes_broadcast_no_table_of_customers(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_BROADCAST_ROWS", 0)
    clean = cleaned_table(spark, SF_SMALL)
    late = F.right(F.col(S.ORDER), F.lit(1)) == "3"
    state = State(spark, scratch_path(spark, "state"))
    first, second = clean.where(~late), clean.where(late)
    state.refresh(first)
    out = refresh_classified(state, CL.classify_orders(first), first, second)
    assert "BroadcastHashJoin" not in _plan(out)
    assert out.count() == clean.count()
    platforms = M.primary_platform(clean)
    assert "BroadcastHashJoin" not in _plan(M.customer_facts_of_days(CL.classified_days(clean), platforms.checkpoint(), None))


def test_identity_clusters_broadcast_no_table_of_ids(spark, monkeypatch):
    monkeypatch.setattr(J, "MAX_BROADCAST_ROWS", 10)
    clean = cleaned_table(spark, SF_SMALL)
    for overlap in ("span", "day"):
        got = ID.identity_clusters(clean, overlap)
        assert "BroadcastHashJoin" not in _plan(got)
        assert got.count() == clean.select(S.USER).distinct().count()
    assert "BroadcastHashJoin" not in _plan(ID.visits(clean))
