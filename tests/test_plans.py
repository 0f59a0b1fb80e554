"""Plans hold no cross join, read only the columns they need, and push filters to the scan."""

import pytest

from tarnweave import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["r4_dom_evasion", "rewritten_routes", "domain_summary", "routes_per_domain", "rule_distribution", "obfuscation_axes", "gtg_edges", "ctg_edges", "asof_lookup", "interval_overlap", "point_in_interval", "running_total_topk", "attribution_rollup", "property_join", "argument_join", "section_diff"])
def test_no_cross_joins(spark, name):
    text = plan(catalog.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name,columns", [("stats_moments", {"l_quantity", "l_returnflag"}), ("opcode_frequency", {"l_partkey", "l_quantity"}), ("cache_miss_ranking", {"l_suppkey", "l_discount"})])
def test_scans_read_only_what_is_needed(spark, name, columns):
    import re

    text = plan(catalog.queries()[name](spark, SF))
    read = next(m for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_" in m)
    assert {c.split(":")[0] for c in read.split(",")} == columns


@pytest.mark.parametrize("name,pushed", [("cache_miss_ranking", "GreaterThan(l_discount,0.05)"), ("record_number", ""), ("slowest_topk", ""), ("set_operations", "GreaterThan(l_quantity,48.0)")])
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(catalog.queries()[name](spark, SF))
