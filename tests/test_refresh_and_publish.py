"""Refreshes against full rebuilds, run comparison, customer layout plans, atomic publishing,
isolated statements, round histogram bins and observed gates."""

import datetime as dt
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from cohortline import schema as S
from cohortline.operators import adhoc as A
from cohortline.operators import dashboard as P
from cohortline.operators import marts as M
from cohortline.operators import snapshots as SN
from cohortline.operators.classify import classify_orders
from cohortline.operators.cleaning import DataQualityError
from cohortline.operators.incremental import State, refresh_classified
from cohortline.plans.registry import cleaned_table
from cohortline.plans.suite import build_marts
from cohortline.session import scratch_path
from cohortline.sources import files as IO
from cohortline.sources.layout import CustomerLayout
from tests.conftest import SF_SMALL


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def some_orders(spark, seed, n=160):
    """Few customers, many days twice, wide gaps, null amounts and platforms."""
    rnd = random.Random(seed)
    base = {f.name: None for f in S.CLEAN_SCHEMA}
    out = []
    for i in range(n):
        day = dt.date(2020, 1, 1) + dt.timedelta(days=rnd.choice([0, 1, 2, 400, 401, 900, 1500]) + rnd.randint(0, 3))
        money = None if rnd.random() < 0.1 else round(rnd.uniform(-50, 99), 2)
        out.append(tuple({**base, S.USER: f"u{rnd.randint(0, 9)}", S.ORDER: f"o{seed}-{i:04d}", S.DATE: day,
                          S.PLATFORM: rnd.choice(["app", "web", "touch", None]), S.GROSS_USD: money, S.MARGIN_USD: money,
                          S.VFM_USD: money, S.PROFIT_USD: money, S.STATUS: "redeemed"}.values()))
    return spark.createDataFrame(out, S.CLEAN_SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshes_equal_a_full_rebuild(spark, seed):
    clean = some_orders(spark, seed)
    place = F.pmod(F.xxhash64(S.ORDER), F.lit(3))                 # batches mix dates: most customers come late
    batches = [clean.where(place == k) for k in range(3)]
    state = State(spark, scratch_path(spark, "state"))
    known, out = batches[0], classify_orders(batches[0])
    state.refresh(batches[0])
    for b in batches[1:]:
        out = refresh_classified(state, out, known, b)
        known = known.unionByName(b)
        assert rows_of(out) == rows_of(classify_orders(known))
        assert rows_of(state.master_customer_table()) == rows_of(M.master_customer_table(known))
    assert rows_of(state.classified(clean)) == rows_of(classify_orders(clean))
    days = clean.agg(F.max(S.DATE)).first()[0]
    again = state.refresh(clean.where("false"))                   # an arrival without rows changes nothing
    assert again.count() == 0 and rows_of(state.master_customer_table(days)) == rows_of(M.master_customer_table(clean))


def test_unfinished_refresh_is_not_seen_and_can_be_repeated(spark, monkeypatch):
    clean = some_orders(spark, 5)
    cut = dt.date(2021, 2, 1)
    state = State(spark, scratch_path(spark, "state"))
    state.refresh(clean.where(F.col(S.DATE) < cut))
    before = rows_of(state.master_customer_table())
    write = State._write

    def lost(self, df, table, gen):
        if table == "commits":
            raise RuntimeError("driver lost")
        write(self, df, table, gen)
    monkeypatch.setattr(State, "_write", lost)
    with pytest.raises(RuntimeError):
        state.refresh(clean.where(F.col(S.DATE) >= cut))
    assert rows_of(state.master_customer_table()) == before
    monkeypatch.setattr(State, "_write", write)
    state.refresh(clean.where(F.col(S.DATE) >= cut))
    assert rows_of(state.master_customer_table()) == rows_of(M.master_customer_table(clean))


# ── runs ────────────────────────────────────────────────────────────────────

def test_excess_sums_to_the_change_and_names_the_planted_cell(spark):
    clean = cleaned_table(spark, SF_SMALL)
    moved = (F.col(S.COUNTRY) == "ASIA") & (F.col(S.DATE) >= F.lit("1997-01-01").cast("date"))
    now = clean.withColumn(S.USER, F.when(moved, F.concat(S.USER, F.lit("-M"))).otherwise(F.col(S.USER)))
    root = scratch_path(spark, "runs")
    with pytest.raises(ValueError, match="two are needed"):
        SN.compare_last_runs(spark, root)
    for df in (clean.limit(3), clean, now):
        SN.write_snapshot(SN.customer_snapshot(df), root)
    assert SN.run_ids(spark, root) == [1, 2, 3]
    cells = SN.compare_last_runs(spark, root).orderBy("rank").collect()
    n = [SN.read_snapshot(spark, root, k).count() for k in (2, 3)]
    assert sum(c["delta"] for c in cells) == n[1] - n[0] > 0
    assert all(c["delta"] == c["customers_now"] - c["customers_before"] == c["added"] + c["moved_in"] - c["gone"] - c["moved_out"] for c in cells)
    assert {c[S.COUNTRY] for c in cells if c["delta"]} == {"ASIA"}
    assert [abs(c["delta"]) for c in cells] == sorted((abs(c["delta"]) for c in cells), reverse=True)
    assert sum(round(c["delta_usd"] * 100) for c in cells) == 0            # the orders are the same


def test_runs_without_customers(spark):
    empty = SN.customer_snapshot(cleaned_table(spark, SF_SMALL).limit(0))
    some = SN.customer_snapshot(cleaned_table(spark, SF_SMALL))
    assert SN.excess_by_cell(empty, empty).count() == 0
    assert {c["customers_before"] for c in SN.excess_by_cell(empty, some).collect()} == {0}


# ── layout ──────────────────────────────────────────────────────────────────

def exchanges_on_customer(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count(f"hashpartitioning({S.USER}")


def test_no_exchange_on_the_customer_key(spark):
    clean = cleaned_table(spark, SF_SMALL)
    lay = CustomerLayout.write(clean, "orders_by_customer_test", scratch_path(spark, "layout"), 3)
    try:
        assert exchanges_on_customer(M.master_customer_table(clean)) > 0           # the plain table needs one
        for fn in (lay.classified_orders, lay.master_customer_table, lay.revenue_mix_6m, lay.revenue_mix_monthly):
            assert exchanges_on_customer(fn()) == 0, fn
        assert rows_of(lay.classified_orders()) == rows_of(classify_orders(clean))
    finally:
        spark.sql("DROP TABLE orders_by_customer_test")


def test_large_customers_are_kept_apart(spark):
    hot = F.right(F.col(S.ORDER), F.lit(1)).isin("0", "3", "6")
    clean = cleaned_table(spark, SF_SMALL).withColumn(S.USER, F.when(hot, F.lit("HOT")).otherwise(F.col(S.USER)))
    lay = CustomerLayout.write(clean, "orders_hot_test", scratch_path(spark, "layout"), 3, hot_rows=100)
    try:
        assert {r[0] for r in lay.hot().select(S.USER).distinct().collect()} == {"HOT"}
        for got, want in ((lay.classified_orders(), classify_orders(clean)), (lay.master_customer_table(), M.master_customer_table(clean)),
                          (lay.revenue_mix_6m(), M.revenue_mix_6m(clean)), (lay.revenue_mix_monthly(), M.revenue_mix_monthly(clean))):
            assert rows_of(got) == rows_of(want)
    finally:
        spark.sql("DROP TABLE orders_hot_test")


# ── publishing ──────────────────────────────────────────────────────────────

def test_refused_or_failed_publish_leaves_the_table(spark):
    df, path = spark.range(10).withColumnRenamed("id", "x"), scratch_path(spark, "pub")

    def refuse(d):
        raise DataQualityError(f"{d.count()} rows refused")
    try:
        IO.publish_table(df, "pub_test", path)
        with pytest.raises(DataQualityError, match="5 rows refused"):
            IO.publish_table(df.limit(5), "pub_test", path, check=refuse)
        assert spark.table("pub_test").count() == 10
        with pytest.raises(Exception, match="boom"):
            IO.publish_table(df.withColumn("x", F.when(F.col("x") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("x"))), "pub_test", path)
        with pytest.raises(ValueError, match="other columns"):
            IO.publish_table(df.withColumn("y", F.lit(1)), "pub_test", path)
        assert spark.table("pub_test").count() == 10 and IO.published_version(spark, "pub_test") == 1
        for n in (3, 4, 5):
            assert IO.publish_table(df.limit(n), "pub_test", path, keep=2).count() == n
        versions = IO._versions(spark, path)
        assert IO.published_version(spark, "pub_test") == versions[-1] and len(versions) == 2
        assert IO.table_properties(spark, "pub_test")["version"] == str(versions[-1])
    finally:
        spark.sql("DROP TABLE IF EXISTS pub_test")


def test_a_reader_keeps_its_version(spark):
    df, path = spark.range(10), scratch_path(spark, "pub")
    try:
        IO.publish_table(df, "pub_reader", path)
        held = spark.read.parquet(f"{path}/v-{IO.published_version(spark, 'pub_reader'):06d}")
        IO.publish_table(df.limit(2), "pub_reader", path)
        assert held.count() == 10 and spark.table("pub_reader").count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS pub_reader")


# ── ad-hoc statements ───────────────────────────────────────────────────────

def test_commands_do_not_run(spark):
    orders = spark.range(5).withColumnRenamed("id", "x")
    spark.range(1).createOrReplaceTempView("bystander")
    for text in ("DROP VIEW bystander", "INSERT INTO bystander SELECT 1", "SET spark.sql.ansi.enabled=false", "CREATE TEMP VIEW z AS SELECT 1",
                 "select 1; drop view bystander", "SELECT 1) UNION ALL SELECT * FROM (SELECT 2", "SHOW TABLES", "CACHE TABLE bystander",
                 "select reflect('java.lang.System', 'currentTimeMillis')", "FROM orders INSERT INTO bystander SELECT *"):
        with pytest.raises(ValueError):
            A.query_orders(spark, orders, text)
    assert spark.table("bystander").count() == 1 and spark.conf.get("spark.sql.ansi.enabled") == "true"
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("_orders")]
    spark.catalog.dropTempView("bystander")


def test_statements_see_their_own_orders(spark):
    def ask(k):
        got = A.query_orders(spark, spark.range(k).withColumnRenamed("id", "x"), "WITH a AS (FROM orders) SELECT count(*) AS n, max(x) AS m FROM a -- all").first()
        return (got["n"], got["m"]) == (k, k - 1)
    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(ask, range(1, 25)))
    assert [r["x"] for r in A.query_orders(spark, spark.range(4).withColumnRenamed("id", "x"), "SELECT x FROM orders ORDER BY x DESC LIMIT 3;").collect()] == [3, 2, 1]


# ── histogram, gates ────────────────────────────────────────────────────────

@pytest.mark.parametrize("values, width", [([1, 12], 1), ([1, 13], 2), ([3], 1), ([0, 59, 59, 7], 5), ([17, 1_000_000], 100_000), ([99, 100], 1)])
def test_round_bins(spark, values, width):
    df = spark.createDataFrame([(v,) for v in values], "total_orders bigint")
    got = P.orders_histogram_round(df).collect()
    assert all(r["bin_start"] % width == 0 and r["bin_end"] - r["bin_start"] == width for r in got) and len(got) <= 12
    assert [r["customers"] for r in got] == [sum(r["bin_start"] <= v < r["bin_end"] for v in values) for r in got]
    assert sum(r["customers"] for r in got) == len(values)
    assert P.orders_histogram_round(df.limit(0)).count() == 0


def test_gates_read_observed_numbers(spark, monkeypatch):
    from cohortline.operators import trust as D

    def unused(*a, **k):
        raise AssertionError("counted again")
    for name in ("assert_contracts", "assert_reconciled", "assert_fresh"):
        monkeypatch.setattr(D, name, unused)
    clean = cleaned_table(spark, SF_SMALL)
    last = clean.agg(F.max(S.DATE)).first()[0]
    log = scratch_path(spark, "log")
    marts = build_marts(clean, run_log=log, fresh_as_of=str(last))
    assert rows_of(marts["master_customer_table"]) == rows_of(M.master_customer_table(clean))
    assert [tuple(r) for r in D.read_run_log(spark, log).collect()] == [(1, clean.count())]
