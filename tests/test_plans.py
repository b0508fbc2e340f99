"""Physical plans keep their shape: no nested loops, pruned scans, limits before the shuffle."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as project

QUERIES = project.queries()


def plan(spark, name):
    return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", ["attach_transcript", "dominant_scene", "zero_shot_label", "semantic_topk_batch", "keyword_rank", "register_verdict"]
)
def test_no_nested_loops(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_rank_limits_before_the_shuffle(spark):
    for name in ("in_flight_board", "canonical_by_hash"):
        p = plan(spark, name)
        assert p.index("Final") < p.index("Partial") and "WindowGroupLimit" in p


def test_page_is_a_top_n(spark):
    assert "TakeOrderedAndProject" in plan(spark, "list_page")


def test_scans_read_only_what_is_used(spark):
    p = plan(spark, "scene_distribution")
    schemas = [line for line in p.splitlines() if "ReadSchema" in line]
    assert schemas and all("props" not in s.split("ReadSchema")[1] for s in schemas)
