"""Physical-plan guards: no cross joins, no row-at-a-time Python, and the
flagship's per-entity work reuses one exchange."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL

from codelens.plans import catalog

catalog.load_all()
QUERIES = catalog.QUERIES
ROWS_ONLY = sorted(set(QUERIES) - set(catalog.ORACLE))  # the oracle sweep checks the others' plans
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_no_cross_join_or_row_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert not [k for k in FORBIDDEN if k in plan], plan


def test_flagship_single_exchange_after_block_step(spark):
    plan = _plan(QUERIES["judge_report"](spark, SF_SMALL))
    above = plan.split("FlatMapCoGroupsInArrow")[0]
    assert len(re.findall(r"Exchange hashpartitioning", above)) == 1, above


def test_taxonomy_levels_are_broadcast(spark):
    plan = _plan(QUERIES["taxonomy_flatten"](spark, SF_SMALL))
    assert plan.count("BroadcastHashJoin") == 4
    assert "SortMergeJoin" not in plan


def test_parquet_scans_are_pruned(spark):
    plan = _plan(QUERIES["two_pass_reconcile"](spark, SF_SMALL))
    for m in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "text" not in m and "lang" not in m, m


def test_runs_from_any_directory():
    """Executors must not need the package installed: run the flagship (which
    ships a pandas step to workers) in a fresh process started elsewhere."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.entry(s).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd="/", env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS ")[1].split()[0]) > 0
