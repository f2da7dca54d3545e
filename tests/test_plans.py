"""Plan-shape guards for every registered query: no cartesian or nested-loop joins, no
Python UDF evaluation, and scans that read only some columns where a table is wide."""

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

# training-data queries may use Python by their definition; their own tests check the native ones
NAMES = sorted(n for n in E.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit()))
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


@pytest.mark.parametrize("name", NAMES)
def test_plan_has_no_cross_join_or_python_udf(spark, name):
    df = E.queries()[name](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


def test_lineitem_scan_is_pruned(spark):
    df = E.queries()["map_conflicts_exact"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan
