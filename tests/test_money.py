"""Rounding helpers against numpy (cleaning) and DuckDB (mart ROUND)."""

import duckdb
import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortline.functions.money import pct_1dp, round2_even, round_half_up

amounts = st.lists(st.one_of(
    st.floats(min_value=-1e7, max_value=1e7, allow_nan=False, allow_infinity=False),
    st.integers(-10**6, 10**6).map(lambda i: i / 1000),      # exact half-cent ties: x.xx5
), min_size=1, max_size=300)


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(amounts)
def test_round2_even_matches_numpy(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(round2_even("x")).collect()]
    assert got == [float(v) for v in np.round(np.array(xs, dtype=float), 2)]


@settings(max_examples=8, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(amounts)
def test_round_half_up_matches_sql_round(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = [r[0] for r in df.select(round_half_up("x", 2)).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute("SELECT round(x * 100) / 100 FROM (SELECT unnest(?::DOUBLE[]) AS x)",
                                      [list(map(float, xs))]).fetchall()]
    assert got == want


def test_pct_null_on_zero_total(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (2, 3)], "a long, b long")
    assert [r[0] for r in df.select(pct_1dp(F.col("a"), F.col("b"))).collect()] == [None, 33.3, 66.7]
