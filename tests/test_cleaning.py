"""Cleaning steps, on hand-made edge rows and on the star-schema fixture."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.operators import cleaning as C
from cohortline.operators import quality as Q
from cohortline.sources.fixture import city_country_lookup, raw_files, raw_orders
from tests.conftest import SF_SMALL


def _clean(make_raw, rows, **kw):
    return C.clean_orders(make_raw(rows), **kw)


# --- merge -------------------------------------------------------------------

def test_merge_row_count(spark):
    hist, recent = raw_files(spark, SF_SMALL)
    assert C.merge_files(hist, recent).count() == hist.count() + recent.count()


def test_merge_aligns_by_name_and_fills_missing(spark, make_raw):
    a = make_raw([{}])
    b = make_raw([{}]).drop("parent_order_uuid").select(*reversed(make_raw([{}]).drop("parent_order_uuid").columns))
    m = C.merge_files(a, b)
    assert m.columns == a.columns
    assert m.where(F.col("parent_order_uuid").isNull()).count() == 1


def test_no_overlap_between_files(spark):
    hist, recent = raw_files(spark, SF_SMALL)
    assert Q.file_overlap(hist, recent).count() == 0
    h2, r2 = raw_files(spark, SF_SMALL, overlap=True)
    assert Q.file_overlap(h2, r2).count() > 0


# --- date ----------------------------------------------------------------------

def test_date_parsed_and_range(spark):
    df = C.clean_orders(raw_orders(spark, SF_SMALL), city_country_lookup(spark, SF_SMALL))
    assert dict(df.dtypes)[S.DATE] == "date"
    lo, hi = df.agg(F.min(S.DATE), F.max(S.DATE)).first()
    assert lo == dt.date(1995, 1, 1) and hi <= dt.date(2001, 12, 31)


def test_short_month_and_day_accepted(make_raw):
    out = C.fix_date_column(make_raw([{"operational_view_date": "2024-1-5"}])).first()[S.DATE]
    assert out == dt.date(2024, 1, 5)


@pytest.mark.parametrize("bad", ["2024-13-01", "2024-01-05 10:00", "05/01/2024"])
def test_bad_date_raises(make_raw, bad):
    with pytest.raises(PySparkException):
        C.fix_date_column(make_raw([{"operational_view_date": bad}])).collect()


# --- country -------------------------------------------------------------------

def test_country_filled_only_when_null(make_raw):
    rows = [{"customer_city": "Lyon", "customer_country": None},
            {"customer_city": "Lyon", "customer_country": "DE"},
            {"customer_city": "Warsaw", "customer_country": None}]
    out = [r[S.COUNTRY] for r in C.fix_missing_country(make_raw(rows)).orderBy(S.ORDER).collect()]
    assert out == ["FR", "DE", "PL"]


def test_unknown_city_stays_null_and_clean_raises(make_raw):
    rows = [{"customer_city": "Atlantis", "customer_country": None}]
    assert C.fix_missing_country(make_raw(rows)).first()[S.COUNTRY] is None
    summary = C.country_fill_summary(make_raw(rows)).first()
    assert (summary["null_before"], summary["filled"], summary["still_null"]) == (1, 0, 1)
    with pytest.raises(PySparkException, match="need a value in customer_country"):
        _clean(make_raw, rows).collect()
    with pytest.raises(C.DataQualityError, match="customer_country"):
        Q.run_quality_checks(_clean(make_raw, rows, guard_keys=False))


def test_ambiguous_lookup_rejected(spark, make_raw):
    lk = spark.createDataFrame([("Lyon", "FR"), ("Lyon", "BE")], "city string, country string")
    with pytest.raises(C.DataQualityError, match="Lyon"):
        C.fix_missing_country(make_raw([{}]), lk)


def test_no_null_country_on_fixture(spark):
    df = C.clean_orders(raw_orders(spark, SF_SMALL), city_country_lookup(spark, SF_SMALL))
    assert df.where(F.col(S.COUNTRY).isNull()).count() == 0
    domain = {r[0] for r in spark.read.parquet(f"{SF_SMALL}/region.parquet").select("r_name").collect()}
    assert Q.accepted_values(df, S.COUNTRY, sorted(domain)).count() == 0


# --- promo ---------------------------------------------------------------------

def test_promo_null_empty_and_blank(make_raw):
    rows = [{"incentive_promo_code": None}, {"incentive_promo_code": ""}, {"incentive_promo_code": "  X\t"},
            {"incentive_promo_code": " Y "}]
    out = [r[S.PROMO] for r in C.fix_promo_code(make_raw(rows)).orderBy(S.ORDER).collect()]
    assert out == ["", "", "X", "Y"]


def test_promo_no_whitespace_on_fixture(spark):
    df = C.clean_orders(raw_orders(spark, SF_SMALL), city_country_lookup(spark, SF_SMALL))
    r = Q.promo_trim_check(df).first()
    assert r["leading_blank_rows"] == 0 and r["trailing_blank_rows"] == 0
    assert df.where(F.col(S.PROMO).isNull()).count() == 0
    assert Q.promo_trim_check(raw_orders(spark, SF_SMALL)).first()["leading_blank_rows"] > 0


# --- types / amounts -----------------------------------------------------------

def test_rounding_is_half_even_on_binary_value(make_raw):
    vals = ["2.665", "0.125", "1.005", "1.015"]
    rows = [{"list_price_operational": v} for v in vals] + [{"fx_rate_loc_to_usd_fxn": "0.2534"}]
    out = C.standardise_column_types(make_raw(rows)).orderBy(S.ORDER).collect()
    assert [r["list_price_operational"] for r in out[:4]] == [2.66, 0.12, 1.0, 1.01]
    assert out[4][S.FX] == 0.25


def test_rate_rounding_can_be_switched_off(make_raw):
    rows = [{"fx_rate_loc_to_usd_fxn": "0.2534", "gross_bookings_operational": "100"}]
    on = _clean(make_raw, rows).first()
    off = _clean(make_raw, rows, fx_round_digits=None).first()
    assert on[S.GROSS_USD] == 25.0 and off[S.GROSS_USD] == 25.34


def test_bad_number_raises(make_raw):
    with pytest.raises(PySparkException):
        C.standardise_column_types(make_raw([{"vfm_operational": "12x"}])).collect()


def test_usd_columns_and_formula(spark):
    df = C.clean_orders(raw_orders(spark, SF_SMALL), city_country_lookup(spark, SF_SMALL))
    for c in S.USD_COLUMNS:
        assert c in df.columns
    assert df.columns == S.CLEAN_COLUMNS
    r = Q.usd_formula_check(df).first()
    assert r["rows"] > 0 and r["mismatches"] == 0


def test_refunded_orders_non_positive(spark):
    df = C.clean_orders(raw_orders(spark, SF_SMALL), city_country_lookup(spark, SF_SMALL))
    r = Q.refund_rule(df).first()
    assert r["refunded_rows"] > 0 and r["violations"] == 0


def test_strings_are_stripped_and_null_kept(make_raw):
    r = C.standardise_column_types(make_raw([{"user_uuid": " u9\t", "customer_city": None}])).first()
    assert r[S.USER] == "u9" and r[S.CITY] is None


# --- uniqueness / nulls / report ---------------------------------------------------

def test_duplicate_order_raises(make_raw):
    df = _clean(make_raw, [{"order_uuid": "dup"}, {"order_uuid": "dup"}, {"order_uuid": "dup"}])
    assert Q.check_duplicates(df).first()["duplicate_rows"] == 2
    with pytest.raises(C.DataQualityError, match="repeat in 2 row"):
        Q.run_quality_checks(df)


@pytest.mark.parametrize("col", ["user_uuid", "order_uuid", "platform", "last_status", "operational_view_date"])
def test_null_key_raises(make_raw, col):
    df = _clean(make_raw, [{col: None}], guard_keys=False)
    with pytest.raises(C.DataQualityError, match=col):
        Q.run_quality_checks(df)
    with pytest.raises(PySparkException):
        _clean(make_raw, [{col: None}]).collect()


def test_quality_report_keys(spark):
    hist, recent = raw_files(spark, SF_SMALL)
    df, report = C.clean(hist, recent, city_country_lookup(spark, SF_SMALL))
    expected = {"total_rows", "unique_orders", "unique_customers", "date_range", "countries", "platforms",
                "last_status_counts", "rows_hist", "rows_recent", "refunded_zero_bookings",
                "country_nulls_fixed", "promo_nulls_standardised"}
    assert expected <= set(report)
    assert report["total_rows"] == report["unique_orders"] == df.count()
    assert report["rows_hist"] + report["rows_recent"] == report["total_rows"]
    assert sum(report["last_status_counts"].values()) == report["total_rows"]
    assert report["platforms"] == sorted(report["platforms"])
    assert report["country_nulls_fixed"] > 0 and report["promo_nulls_standardised"] > 0


def test_country_audit_and_issue_log(spark):
    raw = raw_orders(spark, SF_SMALL)
    audit = C.country_audit(raw, city_country_lookup(spark, SF_SMALL)).collect()
    assert audit and all(r["before_raw"] == "NULL" and r["after_fixed"] for r in audit)
    log = {r["issue"]: r["issue_count"] for r in C.issue_log(raw).collect()}
    assert log["null_customer_country"] == len(audit)
    assert log["date_stored_as_text"] == raw.count()
