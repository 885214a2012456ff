"""Plan guards for every registered query (physical plans at sf0.001):
no cartesian or nested-loop joins, no Expand (multi-distinct blow-up), no
row-at-a-time Python UDF, no rows funnelled into a single partition (only
partial global aggregates may be), and every window partitioned by a key
(never a global window)."""

import re

import pytest

import __spark_entry__ as entry
from quarry.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "Expand", "BatchEvalPython")


def _single_partition_exchanges_carry_only_partials(plan: str) -> bool:
    """A single-partition exchange is fine only above a partial global
    aggregate (one small row per map task), never above raw rows."""
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = next((ln for ln in lines[i + 1:] if ln.strip()), "")
            if not ("HashAggregate(keys=[]" in child and "partial_" in child):
                return False
    return True


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan_has_no_red_flags(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"
    assert _single_partition_exchanges_carry_only_partials(plan), f"{name}: rows funnelled into one partition"
    for m in re.finditer(r"Window \[.*?\], \[([^\]]*)\]", plan):
        assert m.group(1).strip(), f"{name}: window without partition key"
