"""Skew check: one customer owns a third of all orders.

Builds the cleaned sf table, rewrites every third order to the customer
``HOT`` (written as its own table), then runs the day-grain marts and a naive
per-customer window for comparison.  Spark's event log (written to a fresh
scratch folder) gives, per stage, the largest and the median number of
shuffle records a task read — the skew a single hot key causes.

Usage: python tools/skew_check.py [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def stage_skew(log_dir: str, job_group: str) -> list[dict]:
    """(stage, tasks, max/median shuffle records read) for stages of one job group."""
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f)]
    tasks, stage_group, job_stages, job_group_of = {}, {}, {}, {}
    for f in files:
        with open(f) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerJobStart":
                    props = ev.get("Properties") or {}
                    job_group_of[ev["Job ID"]] = props.get("spark.jobGroup.id")
                    job_stages[ev["Job ID"]] = ev.get("Stage IDs", [])
                elif kind == "SparkListenerTaskEnd":
                    m = ev.get("Task Metrics") or {}
                    recs = (m.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                    tasks.setdefault(ev["Stage ID"], []).append(recs)
    for job, group in job_group_of.items():
        for s in job_stages.get(job, []):
            stage_group[s] = group
    out = []
    for s, recs in sorted(tasks.items()):
        # single-task stages are broadcasts / global results, not key skew
        if stage_group.get(s) != job_group or max(recs) == 0 or len(recs) < 2:
            continue
        med = statistics.median(recs)
        out.append({"stage": s, "tasks": len(recs), "max_records": max(recs), "median_records": med,
                    "max_over_median": round(max(recs) / med, 2) if med else None})
    return out


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="cohortline-eventlog-")
    from cohortline.session import build_session, scratch_path
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    # many shuffle partitions, as on a cluster: a hot key stands out against the median
    spark = build_session("local[8]", shuffle_partitions=64, extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                             "spark.eventLog.compress": "false",
                                             # behave like the large scale: shuffle joins, no coalescing
                                             "spark.sql.adaptive.coalescePartitions.enabled": "false",
                                             "spark.sql.autoBroadcastJoinThreshold": "-1",
                                             "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                                             "spark.sql.adaptive.localShuffleReader.enabled": "false",
                                             # skew-join trigger scaled down with the data (default 256 MB)
                                             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256k",
                                             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"})
    from cohortline import schema as S
    from cohortline.operators import classify as CL
    from cohortline.operators import marts as M
    from cohortline.plans.registry import cleaned_table

    base = cleaned_table(spark, sf_dir)
    hot = base.withColumn(S.USER, F.when(F.abs(F.hash(S.ORDER)) % 3 == 0, F.lit("HOT")).otherwise(F.col(S.USER)))
    path = scratch_path(spark, "skewed_orders")
    hot.write.parquet(path)
    skewed = spark.read.parquet(path)
    share = skewed.where(F.col(S.USER) == "HOT").count() / skewed.count()

    runs = {
        "master_customer_table": lambda: M.master_customer_table(skewed),
        "classified_orders": lambda: CL.classify_orders(skewed),
        "revenue_mix_monthly": lambda: M.revenue_mix_monthly(skewed),
        "naive_customer_window": lambda: skewed.withColumn(
            "prev", F.lag(S.DATE).over(Window.partitionBy(S.USER).orderBy(S.DATE, S.ORDER))),
    }
    # a single (customer, day) holding a third of the orders
    hot_day = base.withColumns({
        S.USER: F.when(F.abs(F.hash(S.ORDER)) % 3 == 0, F.lit("HOT")).otherwise(F.col(S.USER)),
        S.DATE: F.when(F.abs(F.hash(S.ORDER)) % 3 == 0, F.lit("2000-01-01").cast("date")).otherwise(F.col(S.DATE)),
    })
    day_path = scratch_path(spark, "skewed_day")
    hot_day.write.parquet(day_path)
    skewed_day = spark.read.parquet(day_path)
    runs["classified_hot_day_range_path"] = lambda: CL.classify_orders(skewed_day, hot_day_rows=10_000)
    runs["classified_hot_day_window_only"] = lambda: CL.classify_orders(skewed_day, hot_day_rows=10**12)
    result = {"hot_share": round(share, 3), "queries": {}}
    for name, fn in runs.items():
        spark.sparkContext.setJobGroup(name, name)
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        result["queries"][name] = {"sec": round(time.perf_counter() - t0, 2)}
    spark.stop()
    for name in runs:
        stages = stage_skew(log_dir, name)
        worst = max(stages, key=lambda s: s["max_records"]) if stages else None
        result["queries"][name]["worst_stage"] = worst
    print(json.dumps(result, indent=1))


if __name__ == "__main__":
    main()
