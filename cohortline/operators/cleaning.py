"""Cleaning: merge, type, repair and convert raw order rows (lazy, row-local).

Every step is a narrow projection except the city lookup, which is a
broadcast join against a lookup whose size is checked first.  Nothing here
shuffles the order rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline import schema as S
from cohortline.functions.dates import parse_date_strict
from cohortline.functions.joins import MAX_BROADCAST_ROWS
from cohortline.functions.money import round2_even
from cohortline.functions.text import strip_ws


class DataQualityError(ValueError):
    """A critical data-quality rule failed."""


# ── C1 ──────────────────────────────────────────────────────────────────────

def merge_files(hist: DataFrame, recent: DataFrame) -> DataFrame:
    """Union by column name; a column missing from one file becomes null."""
    return hist.unionByName(recent, allowMissingColumns=True)


# ── C2 ──────────────────────────────────────────────────────────────────────

def fix_date_column(df: DataFrame, col: str = S.DATE) -> DataFrame:
    """Text dates become DATE; malformed text raises (ANSI mode)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.DateType):
        return df
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return df.withColumn(col, F.to_date(col))
    return df.withColumn(col, parse_date_strict(F.col(col).cast("string")))


# ── C3 / C4 ─────────────────────────────────────────────────────────────────

def default_city_lookup(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(S.CITY_COUNTRY_PAIRS, "city string, country string")


_LOOKUP_STATS: dict[tuple, dict] = {}


def _lookup_stats(lookup: DataFrame, key: str) -> dict:
    """Row count and ambiguity of a lookup, remembered per (plan, input files):
    the same lookup over unchanged files is checked once per session."""
    from cohortline.sources.testdata import hadoop_signature

    spark = lookup.sparkSession
    files = tuple(hadoop_signature(spark, f) for f in sorted(lookup.inputFiles()))
    memo_key = (spark.sparkContext.applicationId, lookup.semanticHash(), key, files)
    if memo_key not in _LOOKUP_STATS or any(sig[1] is None for sig in files):
        per_key = lookup.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        _LOOKUP_STATS[memo_key] = per_key.agg(F.sum("rows").alias("rows"),
                                              F.count_if(F.col("rows") > 1).alias("ambiguous"),
                                              F.max_by(key, "rows").alias("example")).first().asDict()
    return _LOOKUP_STATS[memo_key]


def validate_lookup(lookup: DataFrame, key: str = "city", max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Check the lookup in one small job: each key maps to exactly one row
    (else the join would fan out), and the row count decides whether it may be
    broadcast.  Returns the lookup, broadcast-hinted when it is small enough."""
    stats = _lookup_stats(lookup, key)
    if stats["ambiguous"]:
        raise DataQualityError(f"city lookup maps {stats['ambiguous']} cities to several rows, e.g. {stats['example']!r}")
    return F.broadcast(lookup) if (stats["rows"] or 0) <= max_rows else lookup


def _lookup_join(df: DataFrame, lookup: DataFrame, city_col: str) -> DataFrame:
    lk = validate_lookup(lookup.select(F.col("city").alias("_lk_city"), F.col("country").alias("_lk_country")),
                         key="_lk_city")
    return df.join(lk, F.col(city_col) == F.col("_lk_city"), "left")


def fix_missing_country(df: DataFrame, lookup: DataFrame | None = None,
                        city_col: str = S.CITY, country_col: str = S.COUNTRY) -> DataFrame:
    """Fill null countries from the city lookup; a set country is never overwritten."""
    if lookup is None:
        lookup = default_city_lookup(df.sparkSession)
    joined = _lookup_join(df, lookup, city_col)
    cols = [F.coalesce(F.col(country_col), F.col("_lk_country")).alias(country_col) if c == country_col
            else F.col(c) for c in df.columns]
    return joined.select(*cols)


def country_fill_summary(raw: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """C4: nulls before the lookup, filled by it, still null after (one row)."""
    if lookup is None:
        lookup = default_city_lookup(raw.sparkSession)
    missing = F.col(S.COUNTRY).isNull()
    found = F.col("_lk_country").isNotNull()
    return _lookup_join(raw.select(S.CITY, S.COUNTRY), lookup, S.CITY).agg(
        F.count_if(missing).alias("null_before"), F.count_if(missing & found).alias("filled"),
        F.count_if(missing & ~found).alias("still_null"))


# ── C5 ──────────────────────────────────────────────────────────────────────

def fix_promo_code(df: DataFrame, col: str = S.PROMO) -> DataFrame:
    """Missing promo code means "no promo": null -> '' then strip whitespace."""
    return df.withColumn(col, strip_ws(F.coalesce(F.col(col).cast("string"), F.lit(""))))


# ── C6 / C7 ─────────────────────────────────────────────────────────────────

def standardise_column_types(df: DataFrame, fx_round_digits: int | None = 2) -> DataFrame:
    """Strings: cast + strip (null stays null).  Amounts: ANSI cast to double
    (bad text raises) and numpy-style rounding to 2 decimals.  With
    ``fx_round_digits=None`` the FX rate keeps its full precision."""
    if fx_round_digits not in (2, None):
        raise ValueError("fx_round_digits must be 2 or None")
    exprs = {}
    for c in S.STRING_COLUMNS:
        if c in df.columns:
            exprs[c] = strip_ws(F.col(c).cast("string"))
    for c in S.AMOUNT_COLUMNS:
        if c in df.columns:
            x = F.col(c).cast("double")
            exprs[c] = x if (c == S.FX and fx_round_digits is None) else round2_even(x)
    return df.withColumns(exprs)


# ── C8 ──────────────────────────────────────────────────────────────────────

def add_usd_columns(df: DataFrame) -> DataFrame:
    """value_usd = round2(value_operational * fx); profit = round2(margin_usd + vfm_usd)."""
    rate = F.col(S.FX)
    df = df.withColumns({
        S.GROSS_USD: round2_even(F.col(S.GROSS_OP) * rate),
        S.MARGIN_USD: round2_even(F.col(S.MARGIN_OP) * rate),
        S.VFM_USD: round2_even(F.col(S.VFM_OP) * rate),
    })
    return df.withColumn(S.PROFIT_USD, round2_even(F.col(S.MARGIN_USD) + F.col(S.VFM_USD)))


# ── C9 ──────────────────────────────────────────────────────────────────────

def assert_not_null(df: DataFrame, columns: list[str] = S.KEY_COLUMNS) -> DataFrame:
    """Row-level guard evaluated lazily wherever the column is computed:
    a null key aborts the job instead of flowing into a mart."""
    guards: dict[str, Column] = {
        c: F.coalesce(F.col(c), F.raise_error(F.lit(f"cleaned orders need a value in {c}")).cast(df.schema[c].dataType))
        for c in columns if c in df.columns
    }
    return df.withColumns(guards)


def clean_orders(raw: DataFrame, lookup: DataFrame | None = None, fx_round_digits: int | None = 2,
                 guard_keys: bool = True) -> DataFrame:
    """C2 -> C3 -> C5 -> C6/C7 -> C8 on merged raw rows; 19 typed columns."""
    df = fix_date_column(raw)
    df = fix_missing_country(df, lookup)
    df = fix_promo_code(df)
    df = standardise_column_types(df, fx_round_digits)
    df = add_usd_columns(df)
    df = df.select(*S.CLEAN_COLUMNS)
    return assert_not_null(df) if guard_keys else df


def clean(hist: DataFrame, recent: DataFrame, lookup: DataFrame | None = None, fx_round_digits: int | None = 2,
          checks: bool = True) -> tuple[DataFrame, dict | None]:
    """Merge + clean, then (optionally) run the critical checks and build the report."""
    from cohortline.operators.quality import run_quality_checks

    df = clean_orders(merge_files(hist, recent), lookup, fx_round_digits)
    report = run_quality_checks(df, raw=merge_files(hist, recent)) if checks else None
    return df, report


# ── C10 ─────────────────────────────────────────────────────────────────────

def country_audit(raw: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Rows whose raw country was null: raw value shown as 'NULL' and the filled value."""
    if lookup is None:
        lookup = default_city_lookup(raw.sparkSession)
    nulls = raw.where(F.col(S.COUNTRY).isNull()).select(S.ORDER, S.CITY, S.COUNTRY)
    joined = _lookup_join(nulls, lookup, S.CITY)
    return joined.select(
        S.ORDER, S.CITY,
        F.coalesce(F.col(S.COUNTRY), F.lit("NULL")).alias("before_raw"),
        F.col("_lk_country").alias("after_fixed"),
    )


# ── C11 ─────────────────────────────────────────────────────────────────────

# Issue log text (our wording); counts are computed from the raw rows.
ISSUES = [
    ("null_customer_country", "fill from city lookup", "fixed"),
    ("null_incentive_promo_code", "replace with empty string", "fixed"),
    ("date_stored_as_text", "parse to DATE with a strict pattern", "fixed"),
    ("no_usd_amounts", "derive four USD columns", "enhanced"),
    ("non_positive_gross_bookings", "keep: refunded orders", "kept"),
    ("platform_touch", "keep: grouped with web in platform marts", "kept"),
]


def issue_log(raw: DataFrame) -> DataFrame:
    """One aggregation pass over the raw rows, unpivoted to (issue, issue_count, fix, issue_type)."""
    counts = raw.agg(
        F.count_if(F.col(S.COUNTRY).isNull()).alias("null_customer_country"),
        F.count_if(F.col(S.PROMO).isNull()).alias("null_incentive_promo_code"),
        F.count(F.col(S.DATE)).alias("date_stored_as_text"),
        F.lit(0).cast("bigint").alias("no_usd_amounts"),
        F.count_if(F.col(S.GROSS_OP).cast("double") <= 0).alias("non_positive_gross_bookings"),
        F.count_if(F.col(S.PLATFORM) == "touch").alias("platform_touch"),
    )
    long = counts.unpivot([], [i for i, _, _ in ISSUES], "issue", "issue_count")
    text = raw.sparkSession.createDataFrame(ISSUES, "issue string, fix string, issue_type string")
    return long.join(F.broadcast(text), "issue").select("issue", "issue_count", "fix", "issue_type")
