"""Every registered query with an SQL oracle equals DuckDB on the fixtures."""

from __future__ import annotations

import pytest
from conftest import SF_MID, SF_SMALL
from oracle_harness import compare, duck_connect

import __spark_entry__ as E
from codelens.plans import catalog

catalog.load_all()
ORACLE, QUERIES = catalog.ORACLE, catalog.QUERIES
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def con_small():
    return duck_connect(SF_SMALL)


FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, con_small, name):
    r = compare(spark, QUERIES[name], ORACLE[name], SF_SMALL, con_small)
    plan = r.pop("plan")
    assert r["ok"], r
    # no cross join and no row-at-a-time Python in the plan
    assert not [k for k in FORBIDDEN if k in plan], plan


def test_flagship_equals_oracle_mid(spark):
    r = compare(spark, QUERIES["judge_report"], ORACLE["judge_report"], SF_MID)
    assert r["ok"], r
    assert r["rows_spark"] == 150


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["vec_id", "primary_code", "secondary_code", "score", "score2", "t_score", "within_top_n"]


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
