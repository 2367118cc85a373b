"""Ad-hoc SQL over the cleaned order table (S7/S8) and the example queries (E1–E6)."""

from __future__ import annotations

import re
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

TABLE_NAME = "orders"


# calls into the JVM from SQL: not part of a query over the orders
_CALLS = re.compile(r"\b(reflect|java_method|try_reflect)\s*\(", re.IGNORECASE)


def query_orders(spark: SparkSession, orders: DataFrame, sql: str, name: str = TABLE_NAME) -> DataFrame:
    """Run the query ``sql`` with ``orders`` visible as the table ``name``.

    The text becomes a subquery of a statement that names ``orders`` itself, so only a
    query can stand there: ``DROP``, ``INSERT``, ``SET``, ``CREATE`` and any other command, or a second
    statement, do not parse.  The table exists under a name of its own for each call and only while
    the text is analysed: callers on other threads do not see it, and tables and views of the session stay
    untouched."""
    text = (sql or "").strip().rstrip(";").rstrip()
    if not text:
        raise ValueError("empty SQL statement")
    own = f"_{name}_{uuid.uuid4().hex}"
    orders.createOrReplaceTempView(own)
    try:
        try:
            # alone first: a text must be a whole query, not the end of ours and the start of another
            spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
            df = spark.sql(f"WITH {name} AS (SELECT * FROM {own}) SELECT * FROM (\n{text}\n)")
        except ParseException as e:
            raise ValueError(f"only a single query can be run here: {e.getMessage() if hasattr(e, 'getMessage') else e}") from e
        if _CALLS.search(df._jdf.queryExecution().analyzed().toString()):
            raise ValueError("calls into the JVM are not allowed here")
        return df
    finally:
        spark.catalog.dropTempView(own)


# An exact dollar total: the sum runs over integer cents.
_USD_TOTAL = "CAST(sum(CAST(round(gross_bookings_usd * 100) AS BIGINT)) AS DOUBLE) / 100"

# Example statements (Spark SQL).  Orders are made total (an id or name tie-break),
# so that limits give the same rows on every run.
EXAMPLES = {
    "ex_orders_by_country": f"""
FROM orders
|> AGGREGATE count(1) AS orders, {_USD_TOTAL} AS gross_bookings_usd GROUP BY customer_country
|> ORDER BY gross_bookings_usd DESC, customer_country""",
    "ex_top10_customers": f"""
FROM orders
|> AGGREGATE count(1) AS orders, {_USD_TOTAL} AS total_usd GROUP BY user_uuid
|> ORDER BY total_usd DESC, user_uuid
|> LIMIT 10""",
    "ex_monthly_revenue": f"""
FROM orders
|> AGGREGATE count(1) AS orders, {_USD_TOTAL} AS gross_bookings_usd GROUP BY trunc(operational_view_date, 'MM') AS month
|> ORDER BY month""",
    "ex_promo_aov": f"""
FROM orders
|> EXTEND if(incentive_promo_code = '', 'No promo', 'Promo') AS promo
|> AGGREGATE count(1) AS orders,
             round(try_divide(100 * ({_USD_TOTAL}), CAST(count(gross_bookings_usd) AS DOUBLE))) / 100
               AS avg_order_value_usd GROUP BY promo""",
    "ex_refunded_orders": """
FROM orders
|> WHERE last_status = 'refunded'
|> ORDER BY operational_view_date DESC, order_uuid DESC
|> LIMIT 20
|> SELECT order_uuid, user_uuid, customer_country, operational_view_date, gross_bookings_usd, last_status""",
    "adhoc_sql": "FROM orders |> ORDER BY order_uuid |> LIMIT 10",
}


def run_example(spark: SparkSession, orders: DataFrame, name: str) -> DataFrame:
    return query_orders(spark, orders, EXAMPLES[name])


def order_classification_example(classified: DataFrame) -> DataFrame:
    """E6 output shape (prev_date, seq) from the classified orders, by customer and date."""
    return classified.select("user_uuid", "order_uuid", "operational_view_date",
                             classified["prev_order_date"].alias("prev_date"),
                             classified["order_seq"].alias("seq"),
                             "order_type").orderBy("user_uuid", "operational_view_date", "order_uuid")


def head_rows(df: DataFrame, n: int = 5, *order_cols) -> DataFrame:
    """First ``n`` rows in the given order (a top-k, not a full sort)."""
    return (df.orderBy(*order_cols) if order_cols else df).limit(n)


def tail_rows(df: DataFrame, n: int, *order_cols: str) -> DataFrame:
    """Last ``n`` rows by ``order_cols``: a descending top-k, re-sorted ascending."""
    from pyspark.sql import functions as F

    top = df.orderBy(*[F.col(c).desc() for c in order_cols]).limit(n)
    return top.orderBy(*order_cols)
