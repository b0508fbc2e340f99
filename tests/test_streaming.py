"""Streams drained with availableNow equal the batch results."""

import datetime as dt

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from reelmill.functions.columns import epoch_micros
from reelmill.operators import jobs
from reelmill.plans import library as lib
from reelmill.sources.catalog import Catalogue
from reelmill.streaming import arrivals
from reelmill.streaming import jobs as sj


@pytest.fixture(scope="module")
def event_stream(spark):
    """Job events read as a stream of one parquet file, with an event-time column."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/events"
    rows = lib.job_events(spark, SF_DIR).withColumn("ts", F.timestamp_micros("us"))
    rows.coalesce(1).write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def drain(df, name, mode, tmp):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tmp).trigger(availableNow=True)
    q.start().awaitTermination(120)
    return df.sparkSession.table(name)


def test_state_equals_batch(spark, event_stream, tmp):
    got = drain(sj.stream_job_state(event_stream), "job_states", "complete", tmp).collect()
    assert set(got) == set(jobs.job_state(lib.job_events(spark, SF_DIR)).collect())


def test_transitions_equal_batch(spark, event_stream, tmp):
    got = drain(sj.stream_transitions(event_stream), "transitions", "append", tmp).collect()
    want = jobs.state_transitions(lib.job_events(spark, SF_DIR)).collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_tumbling_closed_windows_equal_batch(spark, event_stream, tmp):
    got = drain(sj.stream_tumbling(event_stream), "tumbling", "append", tmp).collect()
    want = (
        lib.job_events(spark, SF_DIR)
        .groupBy(F.date_trunc("hour", F.timestamp_micros("us")).alias("w"), "stage")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    all_windows = {(r.w, r.stage): r.n for r in want}
    closed = {(r.window_start, r.stage): r.n for r in got}
    assert closed and all(all_windows[k] == n for k, n in closed.items())
    edge = max(k[0] for k in all_windows) - dt.timedelta(hours=2)
    assert {k for k in all_windows if k[0] < edge} <= set(closed)


def test_sessions_hold_all_events_of_closed_sessions(event_stream, tmp):
    rows = drain(sj.stream_session(event_stream), "sessions", "append", tmp).collect()
    assert rows and all(r.began < r.ended and r.n >= 1 for r in rows)


def test_liveness_reports_every_worker(event_stream, tmp):
    beats = event_stream.select(F.col("job_no").alias("worker"), "us", "ts")
    rows = drain(sj.stream_liveness(beats), "liveness", "append", tmp).collect()
    last = {}
    for r in rows:
        last[r.worker] = max(last.get(r.worker, 0), r.last_us)
    want = beats.sparkSession.createDataFrame([], beats.schema)  # schema check only
    assert want.columns == ["worker", "us", "ts"]
    assert len(last) > 1 and any(r.alive for r in rows)


CATALOG = (
    "video_id string, source_path string, content_hash string, file_size_bytes long, status string, "
    "is_duplicate boolean, canonical_video_id string, created_s long"
)
MANIFEST = "video_id string, source_path string, content_hash string, file_size_bytes long, created_s long"


def test_register_stream(spark, tmp):
    def drop(n, rows):
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{tmp}/inbox")

    def run():
        m = arrivals.read_manifests(spark, f"{tmp}/inbox", MANIFEST, max_files=1)
        arrivals.start_register(m, table, f"{tmp}/ckpt").awaitTermination(120)
        return {r.video_id: (r.status, r.is_duplicate, r.canonical_video_id, r.created_s) for r in table.read().collect()}

    table = Catalogue(spark, f"{tmp}/videos", CATALOG, buckets=16)
    drop(1, [("a", "/a", "h1", 1, 10), ("b", "/b", "h1", 1, 11), ("c", "/c", "h2", 1, 12)])
    first = run()
    assert first == {"a": ("queued", False, None, 10), "b": ("done", True, "a", 11), "c": ("queued", False, None, 12)}
    # a new copy of stored content (and a copy of that copy in the same batch) refers to the stored original
    drop(2, [("d", "/d", "h1", 1, 20), ("e", "/e", "h1", 1, 21)])
    second = run()
    assert second["d"] == ("done", True, "a", 20) and second["e"] == ("done", True, "a", 21)
    assert {k: second[k] for k in first} == first
    table.upsert(table.read().where("video_id = 'c'").withColumn("status", F.lit("done")))
    drop(3, [("c", "/c", "h9", 1, 30)])
    assert run()["c"] == ("done", False, None, 12)  # already processed: untouched


def test_first_arrivals(spark, tmp):
    rows = [("h1", 0), ("h1", 5), ("h2", 6)]
    df = spark.createDataFrame([(h, dt.datetime(2024, 1, 1, 0, s)) for h, s in rows], "content_hash string, arrived_at timestamp")
    df.coalesce(1).write.parquet(f"{tmp}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp}/in")
    got = drain(arrivals.first_arrivals(stream), "arrived", "append", f"{tmp}/c").collect()
    assert sorted(r.content_hash for r in got) == ["h1", "h2"]


def test_epoch_micros_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 00:00:01' AS t")
    assert df.select(epoch_micros(F.col("t"))).first()[0] == 1_704_067_201_000_000
