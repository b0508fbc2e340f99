"""Pages by counts per range equal pages by offset, however the times are spread."""

import random

import pytest

from reelmill.operators import browse

SPREADS = {
    "even": lambda rng, i: 1_700_000_000 + 37 * i,
    "one second": lambda rng, i: 5,
    "bunched": lambda rng, i: rng.choice([0, 1, 1, 1, 10**9 + rng.randrange(50)]),
    "missing": lambda rng, i: rng.choice([None, -5, 7, 2**40]),
    "all missing": lambda rng, i: None,
}


@pytest.mark.parametrize("spread", SPREADS)
def test_pages_by_ranges_equal_pages_by_offset(spark, spread):
    rng = random.Random(spread)
    rows = [(i, SPREADS[spread](rng, i)) for i in rng.sample(range(1000), 143)]
    videos = spark.createDataFrame(rows, "video_no long, created_s long")
    segments = spark.createDataFrame([(i % 300,) for i in range(500)], "video_no long")
    show = lambda df: [tuple(r) for r in df.select("video_no", "created_s", "segment_count").collect()]
    for page in (1, 2, 7, 15, 99):
        want = show(browse.list_page(videos, segments, page, 10))
        assert sorted(show(browse.list_page_by_ranges(videos, segments, page, 10, enough=3)), key=str) == sorted(want, key=str)


def test_a_deep_page_sorts_its_range_only(spark, tmp):
    spark.range(50_000).selectExpr("id AS video_no", "id * 10 AS created_s").write.parquet(f"{tmp}/v")
    videos = spark.read.parquet(f"{tmp}/v")
    page = browse.list_page_by_ranges(videos, videos.select("video_no").limit(5), 40_000, 1)
    assert [r.video_no for r in page.collect()] == [10_000]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(created_s," in plan and "LessThanOrEqual(created_s," in plan
    assert browse.list_page_by_ranges(videos.limit(0), videos, 3, 5).count() == 0
