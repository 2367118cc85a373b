"""SQL formulations (DuckDB) of identity linking, run comparison, refreshes and publishing."""

from __future__ import annotations

from cohortline.plans.oracle import _master_customer_parts, base_ctes, cents, mct_ctes, raw_all_sql, with_

# ── identity linking: pairs and label propagation ───────────────────────────

_REISSUED = """moved AS (
  SELECT * REPLACE (user_uuid || '-' || year(operational_view_date) AS user_uuid,
                    CASE WHEN CAST(right(user_uuid, 9) AS INT) % 3 = 0 THEN 'HUB'
                         ELSE 'T' || ((CAST(right(user_uuid, 9) AS INT) * 7 + (CAST(substr(order_uuid, 2, 10) AS BIGINT) % 2) * 13) % 300) END AS customer_city,
                    CASE WHEN CAST(right(user_uuid, 9) AS INT) % 3 = 0 THEN 'H' ELSE customer_country END AS customer_country)
  FROM cleaned
)"""

_LINKED = {
    "span": """pairs AS MATERIALIZED (
  SELECT DISTINCT a.user_uuid AS u, b.user_uuid AS v
  FROM stays a JOIN stays b ON a.customer_city = b.customer_city AND a.customer_country = b.customer_country
   AND a.user_uuid <> b.user_uuid AND a.first_day <= b.last_day AND b.first_day <= a.last_day
)""",
    "day": """pairs AS MATERIALIZED (
  SELECT DISTINCT a.user_uuid AS u, b.user_uuid AS v
  FROM moved a JOIN moved b ON a.customer_city = b.customer_city AND a.customer_country = b.customer_country
   AND a.user_uuid <> b.user_uuid AND a.operational_view_date = b.operational_view_date
)"""}


def _cluster_ctes(overlap: str) -> list[str]:
    return base_ctes() + [_REISSUED, """stays AS MATERIALIZED (
  SELECT user_uuid, customer_city, customer_country, min(operational_view_date) AS first_day, max(operational_view_date) AS last_day
  FROM moved GROUP BY ALL
)""", _LINKED[overlap], """labels(u, c) USING KEY (u) AS (
  SELECT DISTINCT user_uuid, user_uuid FROM moved
  UNION
  SELECT p.v, min(l.c) FROM labels l JOIN pairs p ON p.u = l.u JOIN recurring.labels o ON o.u = p.v
  WHERE l.c < o.c GROUP BY p.v
)""", """clustered AS (
  SELECT u AS user_uuid, c AS cluster_id, count(*) OVER (PARTITION BY c) AS cluster_size FROM labels
)"""]


def identity_clusters_sql(overlap: str = "span") -> str:
    return with_(_cluster_ctes(overlap), "SELECT user_uuid, cluster_id, cluster_size FROM clustered").replace("WITH\n", "WITH RECURSIVE\n", 1)


def identity_excess_sql() -> str:
    return with_(_cluster_ctes("span") + ["""homes AS (
  SELECT cluster_id, count(DISTINCT user_uuid) AS ids,
         arg_min(customer_country, (operational_view_date, order_uuid)) AS customer_country
  FROM clustered JOIN moved USING (user_uuid) GROUP BY cluster_id
)"""], """
SELECT customer_country, CAST(sum(ids) AS BIGINT) AS uuid_count, count(*) AS cluster_count,
       CAST(sum(ids) - count(*) AS BIGINT) AS excess_ids, round((sum(ids) - count(*)) * 1000.0::DOUBLE / count(*)) / 10 AS excess_pct
FROM homes GROUP BY customer_country""").replace("WITH\n", "WITH RECURSIVE\n", 1)


# ── excess over the last run ────────────────────────────────────────────────

def _snapshot(source: str, name: str) -> list[str]:
    return [f"""{name} AS (
  SELECT user_uuid, CAST(date_trunc('month', min(operational_view_date)) AS DATE) AS cohort,
         arg_min(customer_country, (operational_view_date, order_uuid)) AS country,
         sum({cents('gross_bookings_usd')}) AS c
  FROM {source} GROUP BY user_uuid
)"""]


def excess_by_cell_sql() -> str:
    """Counts of both runs per cell by set operations on the ids."""
    return with_(base_ctes() + ["last_orders AS (SELECT * FROM cleaned WHERE operational_view_date < DATE '1999-07-01')", """this_orders AS (
  SELECT * REPLACE (CASE WHEN CAST(right(user_uuid, 9) AS INT) % 4 = 1 AND customer_country = 'EUROPE'
                          AND operational_view_date >= DATE '1998-01-01' THEN user_uuid || '-M' ELSE user_uuid END AS user_uuid)
  FROM cleaned
)"""] + _snapshot("last_orders", "b") + _snapshot("this_orders", "n") + ["""moves AS (
  SELECT cohort, country, count(*) AS nb, 0 AS nn, 0 AS added, count(*) FILTER (user_uuid NOT IN (SELECT user_uuid FROM n)) AS gone,
         0 AS moved_in, count(*) FILTER (EXISTS (SELECT 1 FROM n WHERE n.user_uuid = b.user_uuid
            AND (n.cohort IS DISTINCT FROM b.cohort OR n.country IS DISTINCT FROM b.country))) AS moved_out, -sum(c) AS c
  FROM b GROUP BY ALL
  UNION ALL
  SELECT cohort, country, 0, count(*), count(*) FILTER (user_uuid NOT IN (SELECT user_uuid FROM b)), 0,
         count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE n.user_uuid = b.user_uuid
            AND (n.cohort IS DISTINCT FROM b.cohort OR n.country IS DISTINCT FROM b.country))), 0, sum(c)
  FROM n GROUP BY ALL
)""", """cells AS (
  SELECT cohort, country, sum(nb)::BIGINT AS nb, sum(nn)::BIGINT AS nn, sum(added)::BIGINT AS added, sum(gone)::BIGINT AS gone,
         sum(moved_in)::BIGINT AS moved_in, sum(moved_out)::BIGINT AS moved_out, sum(c) AS c, sum(nn - nb)::BIGINT AS delta
  FROM moves GROUP BY cohort, country
)"""], """
SELECT CAST(row_number() OVER (ORDER BY abs(delta) DESC, cohort NULLS LAST, country NULLS LAST) AS INTEGER) AS rank,
       cohort AS acquisition_cohort, country AS customer_country, nb AS customers_before, nn AS customers_now, added, gone, moved_in, moved_out,
       delta, CAST(c AS DOUBLE) / 100 AS delta_usd,
       round(delta * 1000.0::DOUBLE / nullif(sum(delta) OVER (), 0)) / 10 AS share_pct
FROM cells""")


# ── published table, bounds, today, round bins ──────────────────────────────

def annotation_sql(annotation: dict[str, str]) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in sorted({**annotation, "comment": "cleaned orders, one row per order"}.items()))
    return f"SELECT property, value, (SELECT count(*) FROM orders) AS row_count FROM (VALUES {rows}) t(property, value)"


DATE_BOUNDS = ("1995-01-01", "2001-06-30")


def date_bounds_sql() -> str:
    lo, hi = DATE_BOUNDS
    return with_(base_ctes(), f"""
SELECT min(operational_view_date) AS date_min, max(operational_view_date) AS date_max,
       count(*) FILTER (operational_view_date < DATE '{lo}') AS rows_before,
       count(*) FILTER (operational_view_date > DATE '{hi}') AS rows_after,
       count(*) FILTER (operational_view_date IS NULL) AS rows_undated
FROM cleaned""")


def master_customer_today_sql() -> str:
    ctes, body = _master_customer_parts()
    return with_(ctes, body.replace("(SELECT MAX(operational_view_date) FROM cleaned)", "current_date"))


def orders_histogram_round_sql(most: int = 12) -> str:
    return with_(mct_ctes() + ["lim AS (SELECT min(total_orders) AS lo, max(total_orders) AS hi FROM mct)", f"""w AS (
  SELECT min(m * CAST(pow(10, k) AS BIGINT)) AS w, any_value(lo) AS lo, any_value(hi) AS hi
  FROM lim, (VALUES (1), (2), (5)) a(m), range(15) t(k)
  WHERE hi // (m * CAST(pow(10, k) AS BIGINT)) - lo // (m * CAST(pow(10, k) AS BIGINT)) + 1 <= {most}
)""", "bins AS (SELECT unnest(range(lo // w, hi // w + 1)) AS b, w FROM w)"], """
SELECT CAST(b * w AS BIGINT) AS bin_start, CAST((b + 1) * w AS BIGINT) AS bin_end, count(total_orders) AS customers
FROM bins LEFT JOIN mct ON total_orders // w = b GROUP BY b, w""")


def raw_broken_sql() -> str:
    return f"""SELECT * REPLACE (customer_city || chr(10) || '"' || platform || '", x' AS customer_city) FROM ({raw_all_sql()})"""
