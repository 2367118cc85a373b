"""Cleaned orders laid out for the marts: bucketed and sorted by customer.

The marts group and window by customer.  A table bucketed by ``user_uuid`` is read with
that clustering, so none of M0 to M3 shuffles on the customer key (M2 and M3
shuffle a few rows per order type).  Each bucket is one file sorted by (customer, day, order).

A bucket is read by one task, so a customer with very many orders would fill one: customers above
``hot_rows`` orders, few by construction, are kept apart in a plain table and go the general,
skew-safe way.  Which customers those are is a count, so the split is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.functions.joins import lookup_join
from cohortline.operators import marts as M
from cohortline.operators.classify import _ORDER_COLS, classified_days, classify_orders, day_type
from cohortline.session import scratch_path

HOT_ROWS = 1_000_000


class CustomerLayout:
    """The bucketed table ``name`` and, beside it, the orders of very large customers."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path.rstrip("/")

    @classmethod
    def write(cls, clean: DataFrame, name: str, path: str, buckets: int, hot_rows: int = HOT_ROWS) -> "CustomerLayout":
        """Write both parts of ``clean`` below ``path`` and register the bucketed one as ``name``."""
        spark, out = clean.sparkSession, cls(clean.sparkSession, name, path)
        counts = clean.groupBy(S.USER).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
        found = scratch_path(spark, "hot_customers")
        counts.write.parquet(found)
        marked = lookup_join(clean, spark.read.schema(counts.schema).parquet(found), S.USER, S.ORDER)
        cold, hot = (marked.where(c).select(*S.CLEAN_COLUMNS) for c in (F.col("_n").isNull(), F.col("_n").isNotNull()))
        (cold.repartition(buckets, S.USER).write.mode("overwrite").format("parquet").option("path", f"{out.path}/customers")
         .bucketBy(buckets, S.USER).sortBy(S.USER, S.DATE, S.ORDER).saveAsTable(name))
        hot.write.mode("overwrite").parquet(f"{out.path}/hot")
        return out

    def orders(self) -> DataFrame:
        """Customers of ordinary size, clustered by customer."""
        return self.spark.table(self.name)

    def hot(self) -> DataFrame:
        return self.spark.read.schema(S.CLEAN_SCHEMA).parquet(f"{self.path}/hot")

    def _each(self, ordinary, general) -> DataFrame:
        hot = self.hot()
        one = ordinary(self.orders())
        return one if hot.isEmpty() else one.unionByName(general(hot))

    def classified_orders(self, gap_days: int = S.REACTIVATION_GAP_DAYS) -> DataFrame:
        """M0: one window per customer over clustered rows; no exchange, no join."""
        def windowed(orders: DataFrame) -> DataFrame:
            w = Window.partitionBy(S.USER).orderBy(S.DATE, S.ORDER)
            return (orders.select(*_ORDER_COLS, F.lag(S.DATE).over(w).alias("prev_day"), F.row_number().over(w).cast("bigint").alias("order_seq"))
                    .withColumn("order_type", day_type(gap_days)).withColumnRenamed("prev_day", "prev_order_date"))
        return self._each(windowed, lambda hot: classify_orders(hot, gap_days))

    def classified_days(self, gap_days: int = S.REACTIVATION_GAP_DAYS) -> DataFrame:
        part = lambda orders: classified_days(orders, gap_days)
        return self._each(part, part)

    def _last_day(self):
        return self.orders().select(S.DATE).unionByName(self.hot().select(S.DATE)).agg(F.max(S.DATE)).first()[0]

    def master_customer_table(self, as_of=None, gap_days: int = S.REACTIVATION_GAP_DAYS) -> DataFrame:
        """M1 (``as_of`` defaults to the last day of the whole table)."""
        day = self._last_day() if as_of is None else as_of
        part = lambda orders: M.master_customer_table(orders, day, gap_days)
        return self._each(part, part)

    def revenue_mix_6m(self) -> DataFrame:
        return M.revenue_mix_6m(self.orders().unionByName(self.hot()).select(S.DATE), cdays=self.classified_days())

    def revenue_mix_monthly(self) -> DataFrame:
        return M.revenue_mix_monthly(self.orders(), cdays=self.classified_days())
