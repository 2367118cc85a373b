import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from cohortline.session import build_session

    s = build_session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()


RAW_DEFAULTS = {
    "operational_view_date": "2024-01-05",
    "user_uuid": "u1",
    "customer_city": "Lyon",
    "customer_country": "FR",
    "order_uuid": "o1",
    "parent_order_uuid": "p1",
    "platform": "web",
    "fx_rate_loc_to_usd_fxn": "1.0",
    "list_price_operational": "10.0",
    "deal_discount_operational": "1.0",
    "gross_bookings_operational": "9.0",
    "margin_1_operational": "3.0",
    "vfm_operational": "0.5",
    "incentive_promo_code": None,
    "last_status": "redeemed",
}


def raw_rows(spark, rows):
    """Raw-shaped (all text) frame from partial dicts; missing fields use defaults."""
    from cohortline import schema as S

    full = []
    for i, r in enumerate(rows):
        d = dict(RAW_DEFAULTS)
        d["order_uuid"] = f"o{i:04d}"
        d.update(r)
        full.append(tuple(d[c] for c in S.RAW_COLUMNS))
    return spark.createDataFrame(full, S.RAW_SCHEMA)


@pytest.fixture
def make_raw(spark):
    return lambda rows: raw_rows(spark, rows)
