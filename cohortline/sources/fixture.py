"""Raw-order fixture: the two order files derived from the star schema.

orders ⋈ customer ⋈ nation ⋈ region is mapped to the 15 raw order columns
(nation name = city, region name = country).  The mapping is a contract shared
with the SQL oracle, so both engines see identical raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.sources.testdata import table

# Fixed fixture parameters (shared with the SQL oracle).
FILE_SPLIT_DATE = "1999-07-01"          # historical file: orders before this date
OVERLAP_HIST_END = "1999-08-01"         # overlapping slices for duplicate/overlap checks
NULL_COUNTRY_EVERY = 155                # customer_country is missing when orderkey % 155 = 0

PARTS = ("all", "historical", "recent", "historical_overlap", "recent_overlap")


# nation and region have a fixed cardinality at every scale factor of the star
# schema (25 and 5 rows), so broadcasting them is bounded by definition.
FIXED_SIZE_TABLES = {"nation": 25, "region": 5}


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation ⋈ region: city (nation name) -> country (region name) and keys."""
    n = table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")


def city_country_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's fill-in lookup (one row per city)."""
    return geography(spark, sf_dir).select(F.col("n_name").alias("city"), F.col("r_name").alias("country"))


def _part_filter(part: str) -> Column | None:
    d = F.col("o_orderdate")
    return {
        "all": None,
        "historical": d < F.lit(FILE_SPLIT_DATE).cast("timestamp_ntz"),
        "recent": d >= F.lit(FILE_SPLIT_DATE).cast("timestamp_ntz"),
        "historical_overlap": d < F.lit(OVERLAP_HIST_END).cast("timestamp_ntz"),
        "recent_overlap": d >= F.lit(FILE_SPLIT_DATE).cast("timestamp_ntz"),
    }[part]


def raw_orders(spark: SparkSession, sf_dir: str, part: str = "all") -> DataFrame:
    """Raw orders with the 15 file columns; amounts are doubles, the date is text."""
    if part not in PARTS:
        raise ValueError(f"unknown part {part!r}; expected one of {PARTS}")
    o = table(spark, sf_dir, "orders",
              ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"])
    cond = _part_filter(part)
    if cond is not None:
        o = o.where(cond)
    c = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey"])
    geo = F.broadcast(geography(spark, sf_dir))  # ≤ 25 rows (FIXED_SIZE_TABLES)

    df = (o.join(c, o.o_custkey == c.c_custkey)
           .join(geo, F.col("c_nationkey") == geo.n_nationkey))

    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    status = F.col("o_orderstatus")
    refunded = (status == "P") & (key % 2 == 0)
    prio = F.col("o_orderpriority")
    return df.select(
        F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias(S.DATE),  # zone-independent
        F.col("c_name").alias(S.USER),
        F.col("n_name").alias(S.CITY),
        F.when(key % NULL_COUNTRY_EVERY == 0, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias(S.COUNTRY),
        F.concat(F.lit("O"), F.lpad(key.cast("string"), 10, "0")).alias(S.ORDER),
        F.concat(F.lit("P"), F.lpad((key - key % 2).cast("string"), 10, "0")).alias("parent_order_uuid"),
        F.when(prio.isin("1-URGENT", "2-HIGH"), "app").when(prio == "5-LOW", "touch")
         .otherwise("web").alias(S.PLATFORM),
        (F.lit(1.0) + (F.col("n_nationkey") % 7) * F.lit(0.1234)).alias(S.FX),
        price.alias("list_price_operational"),
        (price * F.lit(0.1)).alias("deal_discount_operational"),
        F.when(refunded, F.when(key % 4 == 0, F.lit(0.0)).otherwise(-price))
         .otherwise(price * F.lit(0.9)).alias(S.GROSS_OP),
        (price * F.lit(0.3)).alias(S.MARGIN_OP),
        (price * F.lit(0.05)).alias(S.VFM_OP),
        F.when(key % 10 < 7, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("  PROMO"), (key % 10).cast("string"), F.lit(" "))).alias(S.PROMO),
        F.when(status == "F", "redeemed").when(status == "O", "unredeemed")
         .when(refunded, "refunded").when(status == "P", "expired").alias(S.STATUS),
    )


def raw_files(spark: SparkSession, sf_dir: str, overlap: bool = False) -> tuple[DataFrame, DataFrame]:
    """(historical, recent) raw files; ``overlap`` makes July 1999 appear in both."""
    if overlap:
        return raw_orders(spark, sf_dir, "historical_overlap"), raw_orders(spark, sf_dir, "recent_overlap")
    return raw_orders(spark, sf_dir, "historical"), raw_orders(spark, sf_dir, "recent")


# ── stand-ins derived from cleaned orders (shared with the SQL oracle) ───────

def reissued_ids(clean: DataFrame) -> DataFrame:
    """Cleaned orders whose customers get a new id every year and order in changing towns; a third
    of the customers all order in one crowded town."""
    customer = F.right(F.col(S.USER), F.lit(9)).cast("int")
    order = F.substring(S.ORDER, 2, 10).cast("bigint")
    crowded = customer % 3 == 0
    town = F.concat(F.lit("T"), ((customer * 7 + (order % 2) * 13) % 300).cast("string"))
    return clean.withColumns({
        S.USER: F.concat_ws("-", S.USER, F.year(S.DATE).cast("string")),
        S.CITY: F.when(crowded, F.lit("HUB")).otherwise(town),
        S.COUNTRY: F.when(crowded, F.lit("H")).otherwise(F.col(S.COUNTRY))})


RUN_CUT, MIGRATION_START = "1999-07-01", "1998-01-01"


def migrated_runs(clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(last run's orders, this run's): the later one has all dates, and a migration gave a quarter of
    one country's customers new ids for their orders from a day on."""
    d = F.col(S.DATE)
    moved = (F.right(F.col(S.USER), F.lit(9)).cast("int") % 4 == 1) & (F.col(S.COUNTRY) == "EUROPE") & (d >= F.lit(MIGRATION_START).cast("date"))
    now = clean.withColumn(S.USER, F.when(moved, F.concat(F.col(S.USER), F.lit("-M"))).otherwise(F.col(S.USER)))
    return clean.where(d < F.lit(RUN_CUT).cast("date")), now


def arriving_batches(clean: DataFrame) -> list[DataFrame]:
    """The cleaned orders as they might arrive: the first file without a tenth of its orders, the second
    file, and the missing tenth, whose dates are late by then."""
    first = F.col(S.DATE) < F.lit(FILE_SPLIT_DATE).cast("date")
    missing = first & (F.right(F.col(S.ORDER), F.lit(1)) == "3")
    return [clean.where(first & ~missing), clean.where(~first), clean.where(missing)]


def one_large_customer(clean: DataFrame) -> DataFrame:
    """Cleaned orders of which about a third belong to one customer on one day."""
    hot = F.right(F.col(S.ORDER), F.lit(1)).isin("0", "3", "6")
    return clean.withColumns({S.USER: F.when(hot, F.lit("HOT")).otherwise(F.col(S.USER)),
                              S.DATE: F.when(hot, F.lit("1997-01-01").cast("date")).otherwise(F.col(S.DATE))})
