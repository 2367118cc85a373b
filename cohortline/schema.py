"""Column lists, Spark schemas and domains of the order data."""

from __future__ import annotations

from pyspark.sql import types as T

DATE = "operational_view_date"
USER = "user_uuid"
ORDER = "order_uuid"
CITY = "customer_city"
COUNTRY = "customer_country"
PLATFORM = "platform"
PROMO = "incentive_promo_code"
STATUS = "last_status"
FX = "fx_rate_loc_to_usd_fxn"
GROSS_OP = "gross_bookings_operational"
MARGIN_OP = "margin_1_operational"
VFM_OP = "vfm_operational"
GROSS_USD = "gross_bookings_usd"
MARGIN_USD = "margin_1_usd"
VFM_USD = "vfm_usd"
PROFIT_USD = "gross_profit_usd"

# Raw file columns, in file order.
RAW_COLUMNS = [
    DATE, USER, CITY, COUNTRY, ORDER, "parent_order_uuid", PLATFORM, FX,
    "list_price_operational", "deal_discount_operational", GROSS_OP,
    MARGIN_OP, VFM_OP, PROMO, STATUS,
]

STRING_COLUMNS = [USER, CITY, COUNTRY, ORDER, "parent_order_uuid", PLATFORM, PROMO, STATUS]

AMOUNT_COLUMNS = [
    FX, "list_price_operational", "deal_discount_operational", GROSS_OP, MARGIN_OP, VFM_OP,
]

USD_COLUMNS = [GROSS_USD, MARGIN_USD, VFM_USD, PROFIT_USD]

CLEAN_COLUMNS = RAW_COLUMNS + USD_COLUMNS

# Columns that must never be null after cleaning.
KEY_COLUMNS = [DATE, USER, ORDER, COUNTRY, PLATFORM, STATUS]

# CSV files are read without inference: every raw field is text.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])


def _clean_type(c: str) -> T.DataType:
    if c == DATE:
        return T.DateType()
    if c in AMOUNT_COLUMNS or c in USD_COLUMNS:
        return T.DoubleType()
    return T.StringType()


CLEAN_SCHEMA = T.StructType([T.StructField(c, _clean_type(c), True) for c in CLEAN_COLUMNS])

# Fixed values (must equal the source application's):
# city -> country fill-in pairs used when customer_country is missing.
CITY_COUNTRY_PAIRS = [
    ("Birmingham", "GB"),
    ("Lyon", "FR"),
    ("Barcelona", "ES"),
    ("Manchester", "GB"),
    ("Phoenix", "US"),
    ("Madrid", "ES"),
    ("Warsaw", "PL"),
    ("Munich", "DE"),
]
# accepted platform values, accepted last_status values, accepted country codes
PLATFORMS = ["app", "web", "touch"]
STATUSES = ["redeemed", "unredeemed", "refunded", "expired"]
COUNTRY_CODES = ["DE", "ES", "FR", "GB", "IT", "PL", "US"]
# date that separates the historical file from the recent one in the report
FILE_BOUNDARY = "2023-07-01"
# order types and the reactivation gap in days (strictly greater than)
ORDER_TYPES = ["new", "reactivated", "retained"]
REACTIVATION_GAP_DAYS = 365
CLASSIFICATION_RULE_VERSION = "gap>365d/v1"
