"""Classification and marts: hand-made edge rows, brute force and cross-checks."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.operators import classify as CL
from cohortline.operators import marts as M
from cohortline.operators import trust as D
from cohortline.operators.cleaning import DataQualityError, clean_orders
from cohortline.plans.registry import cleaned, cleaned_table
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from tests.conftest import SF_SMALL


def _d(s):
    return dt.date.fromisoformat(s)


def _orders(make_raw, spec):
    """spec: (user, date, order id, platform, gross)"""
    rows = [{"user_uuid": u, "operational_view_date": d, "order_uuid": o, "platform": p,
             "gross_bookings_operational": str(g)} for u, d, o, p, g in spec]
    return clean_orders(make_raw(rows))


GAPS = [
    ("a", "2020-01-01", "a1", "app", 10), ("a", "2020-12-31", "a2", "web", 10),   # 365 days (leap year) -> retained
    ("b", "2020-01-01", "b1", "app", 10), ("b", "2021-01-01", "b2", "app", 10),   # 366 -> reactivated
    ("c", "2021-01-01", "c1", "web", 10), ("c", "2021-12-31", "c2", "app", 10),   # 364 -> retained
    ("d", "2021-03-01", "d2", "web", 10), ("d", "2021-03-01", "d1", "app", 10),   # same day: d1 first
    ("d", "2022-06-01", "d3", "web", 20), ("d", "2022-06-01", "d4", "web", 30),   # 457-day gap, two that day
    ("e", "2021-05-05", "e1", "touch", 5),                                         # single order
]


def test_classification_edges(make_raw):
    out = {r[S.ORDER]: r for r in CL.classify_orders(_orders(make_raw, GAPS)).collect()}
    t = {k: v["order_type"] for k, v in out.items()}
    assert t == {"a1": "new", "a2": "retained", "b1": "new", "b2": "reactivated", "c1": "new", "c2": "retained",
                 "d1": "new", "d2": "retained", "d3": "reactivated", "d4": "retained", "e1": "new"}
    assert out["d2"]["prev_order_date"] == _d("2021-03-01") and out["d1"]["prev_order_date"] is None
    assert out["d3"]["prev_order_date"] == _d("2021-03-01") and out["d4"]["prev_order_date"] == _d("2022-06-01")
    assert [out[k]["order_seq"] for k in ["d1", "d2", "d3", "d4"]] == [1, 2, 3, 4]


def test_classification_matches_brute_force(spark):
    clean = cleaned(spark, SF_SMALL)
    got = CL.classify_orders(clean).toPandas().set_index(S.ORDER).sort_index()
    pdf = clean.select(S.USER, S.ORDER, S.DATE).toPandas().sort_values([S.USER, S.DATE, S.ORDER])
    pdf["prev"] = pdf.groupby(S.USER)[S.DATE].shift(1)
    pdf["seq"] = pdf.groupby(S.USER).cumcount() + 1
    gap = (pd.to_datetime(pdf[S.DATE]) - pd.to_datetime(pdf["prev"])).dt.days
    pdf["type"] = ["new" if s == 1 else ("reactivated" if g > 365 else "retained") for s, g in zip(pdf["seq"], gap)]
    pdf = pdf.set_index(S.ORDER).sort_index()
    assert (got["order_type"] == pdf["type"]).all()
    assert (got["order_seq"] == pdf["seq"]).all()
    assert (got["prev_order_date"].fillna(dt.date.min) == pdf["prev"].fillna(dt.date.min)).all()


def test_master_table_edges(make_raw, spark):
    clean = _orders(make_raw, GAPS + [("f", "2021-01-01", "f1", "app", 1), ("f", "2021-01-02", "f2", "web", 1)])
    mct = {r[S.USER]: r for r in M.master_customer_table(clean).collect()}
    assert mct["f"]["primary_platform"] == "app"          # tie -> smaller name
    assert mct["d"]["primary_platform"] == "web"
    assert mct["d"]["total_orders"] == 4 and mct["d"]["reactivation_count"] == 1
    assert mct["d"]["acquisition_cohort"] == _d("2021-03-01")
    assert mct["e"]["days_since_last_order"] == (_d("2022-06-01") - _d("2021-05-05")).days
    assert mct["d"]["total_gross_bookings_usd"] == 70.0 and mct["d"]["avg_order_value_usd"] == 17.5
    fixed = {r[S.USER]: r for r in M.master_customer_table(clean, as_of="2023-01-01").collect()}
    assert fixed["e"]["days_since_last_order"] == (_d("2023-01-01") - _d("2021-05-05")).days
    today = M.master_customer_table(clean, as_of="current_date").where("user_uuid = 'e'").first()
    assert today["days_since_last_order"] == (dt.date.today() - _d("2021-05-05")).days


def test_avg_rounds_half_cent_away_from_zero(make_raw):
    clean = _orders(make_raw, [("h", "2021-01-01", "h1", "web", "0.01"), ("h", "2021-01-02", "h2", "web", "0.02")])
    assert M.master_customer_table(clean).first()["avg_order_value_usd"] == 0.02


def test_join_and_aggregate_forms_agree(spark):
    clean = cleaned(spark, SF_SMALL)
    a = M.master_customer_table(clean, method="aggregate")
    b = M.master_customer_table(clean, method="join")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_six_month_cutoff_is_strict(make_raw):
    spec = [("x", "2024-08-31", "x2", "web", 10), ("x", "2024-02-29", "x1", "web", 100),
            ("y", "2024-03-01", "y1", "app", 1)]
    out = {r["order_type"]: r for r in M.revenue_mix_6m(_orders(make_raw, spec)).collect()}
    # x1 sits on the cutoff day (2024-08-31 minus 6 months = 2024-02-29) and is excluded
    assert set(out) == {"new", "retained"}
    assert out["new"][S.GROSS_USD] == 1.0 and out["retained"][S.GROSS_USD] == 10.0
    assert out["retained"]["pct_share"] == 90.9


def test_zero_month_share_is_null(make_raw):
    spec = [("z", "2021-01-10", "z1", "web", 5), ("w", "2021-01-11", "w1", "web", -5),
            ("z", "2021-02-10", "z2", "web", 3)]
    rows = M.revenue_mix_monthly(_orders(make_raw, spec)).collect()
    jan = [r for r in rows if r["month"] == _d("2021-01-01")]
    assert len(jan) == 1 and jan[0][S.GROSS_USD] == 0.0 and jan[0]["pct_share"] is None


def test_shares_sum_to_100(spark):
    clean = cleaned(spark, SF_SMALL)
    assert abs(sum(r["pct_share"] for r in M.revenue_mix_6m(clean).collect()) - 100) <= 0.2
    for r in M.revenue_mix_monthly(clean).groupBy("month").agg(F.sum("pct_share").alias("s")).collect():
        assert abs(r["s"] - 100) <= 0.2
    for r in M.platform_share_yearly(clean).groupBy("year").agg(F.sum("pct_share").alias("s")).collect():
        assert abs(r["s"] - 100) <= 0.2


def test_platform_summary_counts_customer_in_both_groups(make_raw):
    spec = [("p", "2021-01-01", "p1", "app", 10), ("p", "2021-01-02", "p2", "touch", 30),
            ("q", "2021-01-03", "q1", "web", 20)]
    out = {r["platform_group"]: r for r in M.platform_summary(_orders(make_raw, spec)).collect()}
    assert out["app"]["unique_customers"] == 1 and out["web"]["unique_customers"] == 2
    assert out["web"]["avg_order_value_usd"] == 25.0 and out["web"]["total_gross_bookings_usd"] == 50.0


def test_reconciliation_and_contracts(spark):
    clean = cleaned(spark, SF_SMALL)
    mct = M.master_customer_table(clean)
    assert D.reconciliation(clean, mct).first()["difference"] == 0.0
    assert all(r["violations"] == 0 for r in D.mct_contracts(mct).collect())
    fanned = mct.unionByName(mct.limit(3))   # join fan-out duplicates customers
    assert D.reconciliation(clean, fanned).first()["difference"] != 0.0
    with pytest.raises(DataQualityError, match="user_uuid_unique=3"):
        D.assert_contracts(fanned)


def test_csv_round_trip_keeps_empty_and_na(spark, make_raw):
    clean = clean_orders(make_raw([{"incentive_promo_code": None}, {"incentive_promo_code": "NA"},
                                   {"parent_order_uuid": None}, {"parent_order_uuid": ""}]), guard_keys=False)
    path = scratch_path(spark, "test_csv")
    IO.write_clean(clean, path, fmt="csv")
    back = IO.read_clean(spark, path, fmt="csv").orderBy(S.ORDER).collect()
    assert [r[S.PROMO] for r in back] == ["", "NA", "", ""]
    assert [r["parent_order_uuid"] for r in back] == ["p1", "p1", None, ""]
    assert IO.read_clean(spark, path, fmt="csv").schema == S.CLEAN_SCHEMA


def test_drift_and_freshness(spark):
    clean = cleaned(spark, SF_SMALL)
    n = clean.count()
    log = spark.createDataFrame([(1, int(n * 0.5)), (2, n)], "run_id bigint, row_count bigint")
    rows = D.row_drift_check(clean, log).orderBy("run_id").collect()
    assert [r["within_tolerance"] for r in rows] == [True, False, True]
    asof = spark.createDataFrame([("2001-08-02",), ("2001-08-05",)], "as_of string")
    assert [r["is_fresh"] for r in D.freshness_check(clean, asof).orderBy("as_of").collect()] == [True, False]


def test_hot_day_path_matches_window_path(spark, make_raw):
    from cohortline.operators.sequence import rank_within

    spec = [("h", "2021-01-01", f"h{i:03d}", "web", i) for i in range(40)] + GAPS
    clean = _orders(make_raw, spec)
    normal = CL.classify_orders(clean)
    forced = CL.classify_orders(clean, hot_day_rows=1)   # every multi-order day takes the range path
    assert normal.exceptAll(forced).count() == 0 and forced.exceptAll(normal).count() == 0
    r = {x[S.ORDER]: x["rank"] for x in rank_within(clean, [S.USER, S.DATE], S.ORDER, num_partitions=7).collect()}
    assert [r[f"h{i:03d}"] for i in range(40)] == list(range(1, 41))
    assert r["d1"] == 1 and r["d2"] == 2 and r["e1"] == 1


def test_hot_day_path_on_fixture(spark):
    clean = cleaned(spark, SF_SMALL)
    a, b = CL.classify_orders(clean), CL.classify_orders(clean, hot_day_rows=1)
    assert a.exceptAll(b).count() == 0 and b.count() == a.count()


def test_publish_table_with_lineage(spark):
    clean = cleaned(spark, SF_SMALL)
    path = scratch_path(spark, "published")
    props = {"source_tables": "orders_historical,orders_recent", "refresh": "daily 06:00 UTC",
             "max_lag_hours": "24", "owner": "analytics"}
    t = IO.publish_table(clean.limit(5), "orders_merged_test", path, "cleaned orders, one row per order", props)
    assert t.count() == 5 and IO.read_table(spark, "orders_merged_test").count() == 5
    got = IO.table_properties(spark, "orders_merged_test")
    assert got["data_owner"] == "analytics" and got["max_lag_hours"] == "24"
    assert got["comment"] == "cleaned orders, one row per order"
    spark.sql("DROP TABLE orders_merged_test")


def test_cleaned_table_rebuilt_when_missing(spark):
    from cohortline.plans import materialize
    from cohortline.plans.registry import cleaned_table

    n = cleaned_table(spark, SF_SMALL).count()
    key = materialize._signature(spark, SF_SMALL)
    materialize._WRITTEN[key] = scratch_path(spark, "never_written")   # a folder that does not exist
    again = cleaned_table(spark, SF_SMALL)
    assert again.count() == n and materialize._WRITTEN[key].rsplit("/", 1)[-1].startswith("cleaned_orders")


def test_rank_within_matches_pandas(spark):
    import random

    from cohortline.operators.sequence import rank_within

    rnd = random.Random(7)
    rows = [(("hot" if rnd.random() < 0.6 else f"k{rnd.randint(0, 40)}"), rnd.randint(0, 2), f"x{i:05d}")
            for i in rnd.sample(range(10**5), 3000)]
    df = spark.createDataFrame(rows, "k string, d int, o string")
    got = rank_within(df, ["k", "d"], "o", num_partitions=13).toPandas()
    pdf = pd.DataFrame(rows, columns=["k", "d", "o"])
    pdf["want"] = pdf.groupby(["k", "d"])["o"].rank(method="first").astype(int)
    merged = got.merge(pdf, on=["k", "d", "o"])
    assert len(merged) == len(rows) and (merged["rank"] == merged["want"]).all()


def test_mart_suite_equals_single_marts(spark):
    from cohortline.plans.suite import build_marts

    clean = cleaned_table(spark, SF_SMALL)
    suite = build_marts(clean)
    single = {
        "master_customer_table": M.master_customer_table(clean),
        "revenue_mix_6m": M.revenue_mix_6m(clean),
        "revenue_mix_monthly": M.revenue_mix_monthly(clean),
        "platform_summary": M.platform_summary(clean),
        "platform_share_yearly": M.platform_share_yearly(clean),
    }
    for name, df in single.items():
        got = suite[name]
        assert got.columns == df.columns, name
        assert got.exceptAll(df).count() == 0 and df.exceptAll(got).count() == 0, name


def test_rank_within_large_key_with_carried_columns(spark):
    """240,000 rows of one key over several partitions, twice, against ROW_NUMBER."""
    from cohortline.operators.sequence import rank_within

    df = (spark.range(0, 300_000, 1, 9).select(
        F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 97)).alias("k"),
        F.concat(F.lit("o"), F.xxhash64("id").cast("string")).alias("o"), (F.col("id") * 3).alias("x")))
    want = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("o")).cast("bigint"))
    for n in (8, 64):
        got = rank_within(df, ["k"], "o", num_partitions=n, carry=["x"])
        assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 300_000
