"""Gates that stop a build, header-matched CSV input, order-independent sums, plan shapes."""

import os

import pytest
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.operators import marts as M
from cohortline.operators import trust as D
from cohortline.operators.classify import classify_orders, compare_gaps
from cohortline.operators.cleaning import DataQualityError
from cohortline.plans.registry import QUERIES, cleaned_table
from cohortline.plans.suite import build_marts
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from cohortline.streaming import ingest_once
from tests.conftest import RAW_DEFAULTS, SF_SMALL


def _csv(spark, text: str) -> str:
    path = scratch_path(spark, "csv_case").replace("file:", "")
    os.makedirs(path)
    with open(path + "/a.csv", "w") as f:
        f.write(text)
    return path


def _line(order: list[str], **values) -> str:
    row = {**RAW_DEFAULTS, "incentive_promo_code": "x", **values}
    return ",".join(order) + "\n" + ",".join(row[c] for c in order) + "\n"


def test_columns_are_matched_by_header(spark):
    swapped = list(reversed(S.RAW_COLUMNS))
    row = IO.read_raw_csv(spark, _csv(spark, _line(swapped))).first()
    assert row["platform"] == "web" and row["last_status"] == "redeemed" and row.__fields__ == S.RAW_COLUMNS


def test_missing_column_is_null_and_unknown_raises(spark):
    got = IO.read_raw_csv(spark, _csv(spark, _line([c for c in S.RAW_COLUMNS if c != S.PROMO]))).first()
    assert got[S.PROMO] is None and got[S.ORDER] == "o1"
    with pytest.raises(ValueError, match="surprise"):
        IO.read_raw_csv(spark, _csv(spark, "surprise,user_uuid\n1,2\n"))


def test_files_with_different_headers_raise(spark):
    path = _csv(spark, _line(S.RAW_COLUMNS))
    with open(path + "/b.csv", "w") as f:
        f.write(_line(list(reversed(S.RAW_COLUMNS))))
    with pytest.raises(Exception, match="header does not conform"):
        IO.read_raw_csv(spark, path).collect()


def test_quotes_and_line_breaks_survive(spark, make_raw):
    city = 'a "b", c\\'
    df = make_raw([{"customer_city": city}])
    path = scratch_path(spark, "quotes")
    IO.write_csv(df, path)
    assert IO.read_raw_csv(spark, path).first()["customer_city"] == city
    text = _line(S.RAW_COLUMNS, customer_city='"x ""y"",\nz"')
    assert IO.read_raw_csv(spark, _csv(spark, text), multi_line=True).first()["customer_city"] == 'x "y",\nz'


def test_sums_do_not_depend_on_partitioning(spark):
    clean = cleaned_table(spark, SF_SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    try:
        for n in (1, 8, 64):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            spread = clean.repartition(n, S.ORDER)
            seen.add(str([M.platform_summary(spread).collect(), M.platform_summary(spread, True).collect(),
                          D.platform_by_tenure(spread).collect()]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1


def test_unrounded_mix_sums_before_rounding(spark):
    rows = [(f"u{i}", f"o{i}", 0.004) for i in range(10)]
    df = spark.createDataFrame(rows, f"{S.USER} string, {S.ORDER} string, {S.GROSS_USD} double") \
              .withColumn(S.DATE, F.lit("2024-01-05").cast("date"))
    assert M.revenue_mix_6m(df).first()[S.GROSS_USD] == 0.0
    got = M.revenue_mix_6m(df, round_first=False).first()
    assert got[S.GROSS_USD] == 0.04 and got["pct_share"] == 100.0


def test_gap_comparison_equals_order_level(spark):
    clean = cleaned_table(spark, SF_SMALL)
    got = {r["order_type"]: r for r in compare_gaps(clean, 365, 180).collect()}
    for gap, name in ((365, "orders_gap365"), (180, "orders_gap180")):
        want = {r["order_type"]: r["count"] for r in classify_orders(clean, gap).groupBy("order_type").count().collect()}
        assert {t: r[name] for t, r in got.items() if r[name]} == want


def test_build_stops_on_drift_and_logs_accepted_runs(spark):
    clean = cleaned_table(spark, SF_SMALL)
    log = scratch_path(spark, "run_log")
    build_marts(clean, run_log=log)
    build_marts(clean, run_log=log)
    with pytest.raises(DataQualityError, match="drift"):
        build_marts(clean.where(F.col(S.PLATFORM) == "web"), run_log=log)
    n = clean.count()
    assert sorted(tuple(r) for r in D.read_run_log(spark, log).collect()) == [(1, n), (2, n)]


def test_build_stops_on_stale_data(spark):
    with pytest.raises(DataQualityError, match="behind 2030-01-01"):
        build_marts(cleaned_table(spark, SF_SMALL), fresh_as_of="2030-01-01")


def test_grain_contract_and_reconciliation_raise(spark):
    clean = cleaned_table(spark, SF_SMALL)
    mct = M.master_customer_table(clean)
    twice = mct.unionByName(mct)
    for gate in (D.assert_grain, D.assert_contracts, lambda t: D.assert_reconciled(clean, t)):
        gate(mct)
        with pytest.raises(DataQualityError):
            gate(twice)


def test_ingest_goes_on_from_its_own_checkpoint(spark, make_raw):
    land = scratch_path(spark, "land").replace("file:", "")
    os.makedirs(land)
    out = scratch_path(spark, "ingested")
    for i in (1, 2):
        with open(f"{land}/{i}.csv", "w") as f:
            f.write(_line(S.RAW_COLUMNS, order_uuid=f"o{i}"))
        assert ingest_once(spark, land, out).count() == i


def _plan(spark, name: str) -> str:
    return QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_reports_read_each_side_once(spark):
    from cohortline.operators import dashboard as P

    clean = cleaned_table(spark, SF_SMALL)
    scans = P.orders_histogram_bins(M.master_customer_table(clean, as_of="2001-01-01")) \
        ._jdf.queryExecution().optimizedPlan().toString().count("Relation [")
    assert scans == 1
    assert "Expand" not in _plan(spark, "redemption_rate")
    # orders, customer, nation, region of the raw rows; nation, region of the lookup
    assert _plan(spark, "residual_null_country").count("Relation [") == 6
