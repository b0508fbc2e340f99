"""The stored catalogue in buckets: what a batch touches, replays, failures half way, and the batch rule as the measure."""

import random

import pytest
from pyspark.sql import functions as F

from reelmill.operators import catalog as op
from reelmill.sources.buckets import BucketedTable
from reelmill.sources.catalog import Catalogue

VIDEOS = (
    "video_id string, source_path string, content_hash string, file_size_bytes long, status string, "
    "is_duplicate boolean, canonical_video_id string, created_s long"
)
ARRIVALS = "video_id string, source_path string, content_hash string, file_size_bytes long, created_s long"


def state(df):
    return {r.video_id: tuple(r) for r in df.collect()}


def arrivals(spark, rng, n, start, ids=400, contents=60):
    rows = {f"v{rng.randrange(ids)}": (f"h{rng.randrange(contents)}" if rng.random() < 0.9 else None, start + i) for i in range(n)}
    return spark.createDataFrame([(v, f"/{v}", h, 1, t) for v, (h, t) in rows.items()], ARRIVALS)


def files(folder):
    import pathlib

    return {p.parent.name: {q.name for q in p.parent.glob("*.parquet")} for p in pathlib.Path(folder).rglob("*.parquet")}


def test_batches_equal_the_rule_over_the_whole_table_and_replays_change_nothing(spark, tmp):
    rng = random.Random(1)
    store = Catalogue(spark, f"{tmp}/c", VIDEOS, buckets=32)
    whole = spark.createDataFrame([], VIDEOS)
    for turn in range(4):
        batch = arrivals(spark, rng, 40, 1000 * turn)
        whole = spark.createDataFrame(op.upsert_latest(whole, op.register_arrivals(batch, whole)).collect(), VIDEOS)
        store.register(batch, turn)
        assert state(store.read()) == state(whole)
        before = files(f"{tmp}/c")
        store.register(batch, turn)
        assert files(f"{tmp}/c/videos") == {k: v for k, v in before.items() if k in files(f"{tmp}/c/videos")} and state(store.read()) == state(whole)
        changed = whole.where(F.xxhash64("video_id") % 5 == turn).withColumn("status", F.lit("done"))
        store.upsert(changed)
        whole = spark.createDataFrame(op.upsert_latest(whole, changed).collect(), VIDEOS)
        assert state(store.read()) == state(whole)


def test_ten_ids_touch_at_most_ten_buckets(spark, tmp):
    rng = random.Random(2)
    store = Catalogue(spark, f"{tmp}/c", VIDEOS, buckets=64)
    store.register(arrivals(spark, rng, 300, 0), 0)
    before = files(f"{tmp}/c/videos")
    batch = spark.createDataFrame([(f"v{i}", f"/v{i}", f"fresh{i}", 1, 9000 + i) for i in range(10)], ARRIVALS)
    store.register(batch, 1)
    after = files(f"{tmp}/c/videos")
    assert 1 <= len(store.touched(1)) <= 10
    assert {k for k in after if after[k] != before.get(k)} <= {f"bucket={b}" for b in store.touched(1)}
    plan = store.videos.read([3, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan


def test_a_batch_that_failed_half_way_is_run_again(spark, tmp, monkeypatch):
    batch = spark.createDataFrame([("a", "/a", "h", 1, 1), ("b", "/b", "h", 1, 2)], ARRIVALS)
    store = Catalogue(spark, f"{tmp}/c", VIDEOS, buckets=8)
    own, calls = BucketedTable.write, []

    def fails_second(self, rows):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("lost")
        own(self, rows)

    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "write", fails_second)
        with pytest.raises(OSError):
            store.register(batch, 0)
    assert not store.done(0)
    store.register(batch, 0)
    assert {k: v[4:7] for k, v in state(store.read()).items()} == {"a": ("queued", False, None), "b": ("done", True, "a")}


def test_contents_follow_their_videos(spark, tmp):
    store = Catalogue(spark, f"{tmp}/c", VIDEOS, buckets=4)
    store.register(spark.createDataFrame([("a", "/a", "h1", 1, 1)], ARRIVALS), 0)
    store.upsert(store.read().withColumn("content_hash", F.lit("h2")))
    store.register(spark.createDataFrame([("b", "/b", "h1", 1, 2), ("c", "/c", "h2", 1, 3)], ARRIVALS), 1)
    got = state(store.read())
    assert got["b"][5] is False and got["c"][6] == "a"


def test_two_failures_of_one_item_are_one_row(spark):
    videos = spark.createDataFrame([("a", "done", None), ("b", "done", None)], "video_id string, status string, error_message string")
    failures = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", None)], "video_id string, message string")
    got = {r.video_id: (r.status, r.error_message) for r in op.apply_failures(videos, failures).collect()}
    assert got == {"a": ("failed", "two"), "b": ("done", None)} and op.apply_failures(videos, failures).count() == 2


def test_change_feed_by_hand(spark):
    schema = "video_id string, x int, y array<string>"
    before = spark.createDataFrame([("a", 1, None), ("b", None, ["p"]), ("c", 3, []), ("d", 4, [])], schema)
    after = spark.createDataFrame([("a", None, None), ("b", None, ["p"]), ("c", 3, None), ("e", None, None)], schema)
    got = {r.video_id: r.change for r in op.change_feed(before, after.select("y", "video_id", "x")).collect()}
    assert got == {"a": "update", "c": "update", "d": "delete", "e": "insert"}
