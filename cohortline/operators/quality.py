"""Data-quality rules (Q1–Q17) as aggregations; critical ones can raise.

Every rule is one aggregation pass (partial aggregation before any shuffle);
only duplicate detection and file overlap shuffle the id column, which a
uniqueness test cannot avoid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.money import round2_even
from cohortline.operators.cleaning import DataQualityError


def _scalar(df: DataFrame, expr: Column) -> Column:
    return df.agg(expr).scalar()


# ── Q1 ──────────────────────────────────────────────────────────────────────

def check_duplicates(df: DataFrame, key: str = S.ORDER) -> DataFrame:
    """Rows that repeat an earlier key (2nd+ copies) and number of repeated keys.
    Null keys count as equal to each other."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
                       F.count(F.lit(1)).alias("duplicated_keys"))


# ── Q2 / Q11 ────────────────────────────────────────────────────────────────

def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, null_count) for the given columns, one aggregation pass."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column_name", "null_count")


def check_key_nulls(df: DataFrame, columns: list[str] = S.KEY_COLUMNS) -> DataFrame:
    return null_counts(df, [c for c in columns if c in df.columns])


def null_profile(df: DataFrame) -> DataFrame:
    """Raw profile: null count per column, only columns with nulls."""
    return null_counts(df, df.columns).where(F.col("null_count") > 0)


# ── Q12 ─────────────────────────────────────────────────────────────────────

def type_profile(df: DataFrame) -> DataFrame:
    """Type of every column as its values show it: ``double`` or ``date`` where all
    non-null values read as one, else ``string`` (also where there are none), with the
    number of values and of those that read as each.  One aggregation pass."""
    def of(c: str) -> Column:
        v = F.col(c).cast("string")
        values, numbers = F.count(v), F.count(v.try_cast("double"))
        dates = F.count_if(v.rlike(r"^\d{4}-\d{2}-\d{2}$"))
        kind = (F.when((values > 0) & (numbers == values), "double")
                 .when((values > 0) & (dates == values), "date").otherwise("string"))
        return F.struct(F.lit(c).alias("column_name"), kind.alias("data_type"), values.alias("n_values"),
                        numbers.alias("n_numbers"), dates.alias("n_dates"))

    return df.agg(F.array(*[of(c) for c in df.columns]).alias("profile")).select(F.inline("profile"))


# ── Q3–Q10 ─────────────────────────────────────────────────────────────────

def _status_counts_text(df: DataFrame) -> Column:
    """'status:count,…' ordered by count desc, then status (value_counts order)."""
    counts = df.groupBy(S.STATUS).agg(F.count(F.lit(1)).alias("n"))
    text = counts.agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(S.STATUS).alias("s"),
                                              F.col("n").alias("n")))),
        lambda x: F.concat(x["s"], F.lit(":"), x["n"].cast("string"))), ","))
    return text.scalar()


def critical_counts(df: DataFrame) -> dict:
    """Duplicate order rows and key-column nulls from one aggregation job.

    Duplicates (2nd+ copies, nulls equal to each other) are
    rows − distinct non-null ids − (1 if any id is null)."""
    keys = [c for c in S.KEY_COLUMNS if c in df.columns]
    row = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(S.ORDER).alias("ids"),
                 *[F.count_if(F.col(c).isNull()).alias(c) for c in keys]).first()
    return {"duplicate_rows": row["rows"] - row["ids"] - (1 if row[S.ORDER] else 0),
            "nulls": {c: row[c] for c in keys}}


def raise_on_critical(counts: dict, where: str = "") -> None:
    if counts["duplicate_rows"]:
        raise DataQualityError(f"order ids repeat in {counts['duplicate_rows']} row(s){where}")
    for c, n in counts["nulls"].items():
        if n:
            raise DataQualityError(f"{n} row(s) without {c}{where}")


REPORT_COLUMNS = ["total_rows", "unique_orders", "unique_customers", "date_min", "date_max", "countries",
                  "platforms", "last_status_counts", "rows_hist", "rows_recent", "refunded_zero_bookings"]


def _report_frame(clean: DataFrame, raw: DataFrame | None, boundary: str) -> DataFrame:
    """The report plus key-column null counts: one aggregation of the cleaned table, narrow ones
    of its status, order and customer columns and one of the raw rows.  The three lists hold different
    values only; check accepted values first where the domains are not known."""
    d = F.col(S.DATE)
    b = F.lit(boundary).cast("date")
    base = clean.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.date_format(F.min(d), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max(d), "yyyy-MM-dd").alias("date_max"),
        F.array_join(F.array_sort(F.collect_set(S.COUNTRY)), ",").alias("countries"),
        F.array_join(F.array_sort(F.collect_set(S.PLATFORM)), ",").alias("platforms"),
        F.count_if(d < b).alias("rows_hist"),
        F.count_if(d >= b).alias("rows_recent"),
        F.count_if((F.col(S.STATUS) == "refunded") & (F.col(S.GROSS_OP) <= 0)).alias("refunded_zero_bookings"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in S.KEY_COLUMNS if c in clean.columns],
    )
    cols = [F.col(c) for c in base.columns]
    cols.append(_status_counts_text(clean).alias("last_status_counts"))
    # one narrow aggregate each: two distinct columns in one would expand every row before its shuffle
    cols += [_scalar(clean, F.count_distinct(c)).alias(name) for c, name in ((S.ORDER, "unique_orders"), (S.USER, "unique_customers"))]
    if raw is not None:
        # one subquery with both counts: the raw side is planned once
        nulls = _scalar(raw, F.struct(F.count_if(F.col(S.COUNTRY).isNull()).alias("country"),
                                      F.count_if(F.col(S.PROMO).isNull()).alias("promo")))
        base = base.withColumn("_raw", nulls)
        cols += [(F.col("_raw")["country"] - F.col(f"_null_{S.COUNTRY}")).alias("country_nulls_fixed"),
                 F.col("_raw")["promo"].alias("promo_nulls_standardised")]
    return base.select(*cols)


def quality_report(clean: DataFrame, raw: DataFrame | None = None, boundary: str = S.FILE_BOUNDARY) -> DataFrame:
    """One-row report (the 12 keys); repair counts come from the raw rows."""
    extra = ["country_nulls_fixed", "promo_nulls_standardised"] if raw is not None else []
    return _report_frame(clean, raw, boundary).select(*REPORT_COLUMNS, *extra)


def run_quality_checks(clean: DataFrame, raw: DataFrame | None = None, boundary: str = S.FILE_BOUNDARY) -> dict:
    """Raise on duplicate ids or null keys; otherwise return the report as a dict.

    Duplicates (2nd+ copies, nulls equal to each other)
    are rows − distinct non-null ids − (1 if any id is null)."""
    row = _report_frame(clean, raw, boundary).first().asDict()
    raise_on_critical({
        "duplicate_rows": row["total_rows"] - row["unique_orders"] - (1 if row[f"_null_{S.ORDER}"] else 0),
        "nulls": {c: row[f"_null_{c}"] for c in S.KEY_COLUMNS if f"_null_{c}" in row},
    })
    row = {k: v for k, v in row.items() if not k.startswith("_null_")}
    row["date_range"] = (row.pop("date_min"), row.pop("date_max"))
    row["countries"] = row["countries"].split(",") if row["countries"] else []
    row["platforms"] = row["platforms"].split(",") if row["platforms"] else []
    row["last_status_counts"] = {k: int(v) for k, v in
                                 (p.split(":") for p in (row["last_status_counts"] or "").split(",") if p)}
    return row


# ── Q6 / Q7 ─────────────────────────────────────────────────────────────────

def distinct_values(df: DataFrame, columns: tuple[str, ...] = (S.COUNTRY, S.PLATFORM)) -> DataFrame:
    """(column_name, value) distinct rows for each listed column."""
    parts = [df.select(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")).distinct()
             for c in columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy("column_name", F.col("value").asc_nulls_last())


def status_distribution(df: DataFrame) -> DataFrame:
    return (df.groupBy(S.STATUS).agg(F.count(F.lit(1)).alias("orders"))
              .orderBy(F.col("orders").desc(), S.STATUS))


# ── Q13 / Q14 ───────────────────────────────────────────────────────────────

def file_overlap(hist: DataFrame, recent: DataFrame, key: str = S.ORDER) -> DataFrame:
    """Ids present in both files (set intersection)."""
    return hist.select(key).intersect(recent.select(key))


def accepted_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values outside the accepted domain (null included) with their row counts."""
    bad = F.col(column).isNull() | ~F.col(column).isin(*allowed)
    return df.where(bad).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


# ── Q15–Q17 ─────────────────────────────────────────────────────────────────

def refund_rule(df: DataFrame) -> DataFrame:
    """refunded ⇒ gross_bookings_operational ≤ 0."""
    refunded = F.col(S.STATUS) == "refunded"
    return df.agg(F.count_if(refunded).alias("refunded_rows"),
                  F.count_if(refunded & ~(F.col(S.GROSS_OP) <= 0)).alias("violations"))


def promo_trim_check(df: DataFrame) -> DataFrame:
    p = F.col(S.PROMO)
    return df.agg(F.count_if(p.startswith(" ")).alias("leading_blank_rows"),
                  F.count_if(p.endswith(" ")).alias("trailing_blank_rows"))


def usd_formula_check(df: DataFrame, rate_digits: int | None = None) -> DataFrame:
    """Recompute gross_bookings_usd = round2(gross_op × rate) and count rows
    whose stored value differs.  ``rate_digits=2`` recomputes with a rate
    rounded to 2 decimals (shows rows affected by rounding the rate first)."""
    rate = F.col(S.FX) if rate_digits is None else round2_even(F.col(S.FX))
    expected = round2_even(F.col(S.GROSS_OP) * rate)
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.count_if(~expected.eqNullSafe(F.col(S.GROSS_USD))).alias("mismatches"))


# ── Q18 ─────────────────────────────────────────────────────────────────────

def date_bounds_check(df: DataFrame, earliest: str, latest: str) -> DataFrame:
    """Date range and the rows outside ``[earliest, latest]`` or without a date."""
    d = F.col(S.DATE)
    return df.agg(F.min(d).alias("date_min"), F.max(d).alias("date_max"),
                  F.count_if(d < F.lit(earliest).cast("date")).alias("rows_before"),
                  F.count_if(d > F.lit(latest).cast("date")).alias("rows_after"), F.count_if(d.isNull()).alias("rows_undated"))
