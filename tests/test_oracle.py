"""Every registered query against its SQL oracle (DuckDB) on the small tables."""

import pytest

import __spark_entry__ as E
from cohortline.plans.registry import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tools.compare import compare, duck

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert r["status"] == "ok", r


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns[0] == "user_uuid" and df.count() > 0
