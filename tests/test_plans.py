"""Physical-plan properties of the registered queries: no cartesian products or
nested-loop joins; top-k limited before the shuffle; scans read only the
columns they need."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF0001

QUERIES = E.queries()
NON_ML = sorted(k for k in QUERIES if not k.startswith("ml_") and k not in ("sort_leaderboard", "sink_artifacts"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NON_ML)
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(QUERIES[name](spark, SF0001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_top_k_limited_before_shuffle(spark):
    from tablewright.operators.eda import top_values
    from tablewright.sources.tables import table
    df = top_values(table(spark, SF0001, "lineitem"), ["l_returnflag", "l_suppkey"], 5)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_scans_are_pruned(spark):
    from tablewright.operators.eda import histograms
    from tablewright.sources.tables import table
    df = histograms(table(spark, SF0001, "lineitem"), ["l_quantity", "l_discount"], 10)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", df._jdf.queryExecution().executedPlan().toString())
    assert schemas and all(set(s.split(",")) <= {"l_quantity:double", "l_discount:double"} for s in schemas)
