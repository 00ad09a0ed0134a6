"""Each registered query on the small tables: plans without cross joins, and rows equal to its SQL where there is any."""

from __future__ import annotations

import pytest
from helpers import SF_SMALL
from oracle_harness import compare, duck_connect

from codelens.llm import queries

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")
NATIVE = ("op3_chat_formatting", "op7_exact_dedup", "op10_pii")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    result = compare(spark, queries.QUERIES[name], queries.ORACLE[name], SF_SMALL, duck_connect(SF_SMALL))
    assert result["ok"], {k: v for k, v in result.items() if k != "plan"}


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [k for k in (*FORBIDDEN, "Python", "Pandas", "Arrow") if k in plan], plan
