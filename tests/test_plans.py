"""What the plans of typical queries must and must not contain."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["d01_take_k", "d03_select_unique_report", "d10_drop_prompt_groups", "e02_summarize", "e07_latency_overall", "e17_inventory_check", "c06_convert_scenarios", "t01_build_prompts", "v02_block_drift"])
def test_no_nested_loops_and_no_row_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text)


def test_only_needed_columns_are_read(spark):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(entry.queries()["d18_sample_per_group"](spark, SF)))
    assert schemas and all("text" not in s for s in schemas)


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["e07_value_summary"](spark, SF))
    assert "IsNotNull(value)" in re.search(r"PushedFilters: \[([^\]]*)\]", text)[1]


def test_scoring_does_not_shuffle_logits(spark):
    # The report reads answers only, so traces stop before the join on id.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = plan(entry.queries()["e04_report_lines"](spark, SF)).splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = [lines[i + 1] for i, line in enumerate(lines) if re.search(r"Exchange hashpartitioning\(id#", line)]
    assert len(below) == 2 and not any(re.search(r"(AS traces#|, traces#)\d+[,\]]", line) for line in below)


def test_window_ranks_inside_hash_pieces(spark):
    text = plan(entry.queries()["d01_take_k"](spark, SF))
    assert re.search(r"Window \[row_number\(\) windowspecdefinition\(source#\d+, _piece#\d+", text)
