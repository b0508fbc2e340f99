"""Segments are dealt by video once, into parts of bounded size, and their summaries shuffle no values."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as project
from reelmill.plans import library

QUERIES = project.queries()


def test_more_segments_make_more_parts(spark, monkeypatch):
    monkeypatch.setattr(library, "SEGMENT_ROWS", 500)
    rows = library.table(spark, SF_DIR, "lineitem").count()
    assert library.segments(spark, SF_DIR).rdd.getNumPartitions() == -(-rows // 500) > spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["video_rollup", "rollup_majority", "dominant_value"])
def test_values_are_summed_up_where_the_segments_are(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(facet" not in plan and "facet#" in plan
    above = plan[: plan.index("Generate inline")]
    assert "facet" not in "".join(line for line in above.splitlines() if "Exchange" in line)
    assert not [line for line in above.splitlines() if "Exchange" in line]
