"""Build the marts together, classifying the order days once.

M1, M2 and M3 all start from the same (customer, day) classification — an
aggregation plus a per-customer window.  Run separately they repeat it; here
it is computed once and its lineage cut with a reliable ``checkpoint()``
into the cluster's shared ``spark.checkpoint.dir``, so the three marts are
cheap aggregations over the checkpointed day rows and a lost executor re-reads
files instead of recomputing the classification.

The build stops on a failed gate: grain and contracts of the customer table, its
reconciliation with the orders, and, where the caller names a run log or a date,
row-count drift and freshness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation

from cohortline import schema as S
from cohortline.operators import marts as M
from cohortline.operators import trust as T
from cohortline.operators.classify import classified_days
from cohortline.session import ensure_checkpoint_dir


def build_marts(clean: DataFrame, gap_days: int = S.REACTIVATION_GAP_DAYS, as_of=None,
                run_log: str | None = None, drift_tolerance_pct: float = 5.0,
                fresh_as_of: str | None = None, max_lag_days: int = 1) -> dict[str, DataFrame]:
    """M1–M5 (and the M2/M4 variants) as DataFrames sharing one day classification.

    ``run_log`` is the folder of the persisted (run_id, row_count) log and switches the
    drift gate on; ``fresh_as_of`` (a date) switches the freshness gate on.  Every failed gate
    raises ``DataQualityError``; the run is logged only when all the others hold."""
    spark = clean.sparkSession
    ensure_checkpoint_dir(spark)
    # what the gates compare is counted while the two tables are written: no scan of its own
    seen, built = Observation("orders"), Observation("customers")
    watched = clean.observe(seen, *T.order_totals())
    cdays = classified_days(watched, gap_days).checkpoint(eager=True)
    if fresh_as_of is not None and not T.is_fresh(seen.get["last_day"], fresh_as_of, max_lag_days):
        T.assert_fresh(clean, fresh_as_of, max_lag_days)
    mct = M.master_customer_table(clean, as_of=as_of, cdays=cdays).observe(built, *T.customer_totals()).checkpoint(eager=True)
    # an observed number can only be off after a lost stage ran twice: before a build is refused it is counted again
    T.assert_grain(mct)
    if any(built.get[c] for c in T.CUSTOMER_RULES):
        T.assert_contracts(mct)
    if seen.get["cents"] != built.get["cents"]:
        T.assert_reconciled(clean, mct)
    if run_log is not None:
        T.assert_drift_and_log(clean, run_log, drift_tolerance_pct, seen.get["orders"])
    return {
        "master_customer_table": mct,
        "revenue_mix_6m": M.revenue_mix_6m(clean, cdays=cdays),
        "revenue_mix_6m_exact": M.revenue_mix_6m(clean, round_first=False),
        "revenue_mix_monthly": M.revenue_mix_monthly(clean, cdays=cdays),
        "platform_summary": M.platform_summary(clean),
        "platform_summary_rounded": M.platform_summary(clean, round_first=True),
        "platform_share_yearly": M.platform_share_yearly(clean),
    }
