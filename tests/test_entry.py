"""Registered queries against their SQL at the smallest scale, and a few plan promises."""

from __future__ import annotations

import pytest

from __spark_entry__ import entry
from tools.compare import compare, connect
from workload.queries import QUERIES
from workload.sql import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, con, key):
    assert compare(spark, con, SF, key, QUERIES[key], SQL[key]) is None


def test_entry(spark):
    assert entry(spark).count() > 0


MASKING = [k for k in QUERIES if k.startswith(("mask_", "mess_", "gen_"))]


@pytest.mark.parametrize("key", MASKING)
def test_row_work_has_no_shuffle_and_no_python(spark, key):
    plan = QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Pandas" not in plan
