"""What the physical plans must and must not contain."""

import re

import pytest

import __spark_entry__ as driver
from evenkeel.operators import report
from evenkeel.plans.fixtures import relations
from evenkeel.spec import CompareSpec

QUERIES = driver.queries()
# A reading of all of these through the driver's plan printer would run a stream.
STREAMS = {n for n in QUERIES if n.startswith("stream") or n in ("sliding_counts", "tumbling_counts", "activity_sessions")}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_join(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_keyed_compare_shuffles_each_side_once(spark, sf_dir):
    for spec in (CompareSpec(keys=("o_orderkey",)), CompareSpec(keys=("o_orderkey",), null_safe_keys=True)):
        plan = plan_of(report.summary(*relations(spark, sf_dir, "src", "tgt"), spec))
        assert len(re.findall(r"Exchange hashpartitioning", plan)) == 2


def test_multiset_compare_shuffles_once(spark, sf_dir):
    assert len(re.findall(r"Exchange ", plan_of(QUERIES["multiset_diff"](spark, sf_dir)))) == 1


def test_scans_read_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["missing_in_target"](spark, sf_dir))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert "o_orderkey:bigint" in schemas


def test_filters_reach_the_scan(spark, sf_dir):
    plan = plan_of(QUERIES["diff_filtered"](spark, sf_dir))
    assert "GreaterThan(o_totalprice,100000.0)" in plan
