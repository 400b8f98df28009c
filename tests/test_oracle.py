"""Every registered query with an oracle must match DuckDB at sf0.01;
queries without one must still run."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(__file__)), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

from conftest import SF_ORACLE, SF_SMALL  # noqa: E402

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_ORACLE)
    assert r["status"] in ("ok", "rows-only"), r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1
    assert df.columns == ["no_balance", "rate", "n", "mean_Balance_per_Product",
                          "mean_Inactive_x_Balance"]


def test_flagship_runs_on_smallest_scale(spark):
    assert QUERIES["churn_rate_by_balance_flag"](spark, SF_SMALL).count() >= 1
