"""Stored postings: against the scan of all tokens, before and after updates, and what a search reads."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.operators import postings, search

SEGMENT = "video_no long, seg_index int, status string, tokens array<string>"
WORDS = [f"w{i}" for i in range(40)] + ["the", "the", "the", "and", "été", "日本"]


def rows_of(rng, videos, words=WORDS):
    return [(v, s, "soft_deleted" if v % 7 == 3 else "done", [rng.choice(words) for _ in range(rng.randrange(30))]) for v in videos for s in range(2)]


def ranked(df):
    return [tuple(r) for r in df.select("video_no", "seg_index", "score").collect()]


@pytest.mark.parametrize("query", ["the", "the AND, the", "été 日本", "w1 w2 w3", "unknown", "unknown the", "?!"])
def test_index_equals_scan_also_after_updates(spark, tmp, query):
    rng = random.Random(query)
    rows = rows_of(rng, range(60)) + [(90, 0, "done", [])]
    path, segments = f"{tmp}/index", spark.createDataFrame(rows, SEGMENT)
    postings.build_index(segments, path, buckets=8, parts=2)

    def same(now):
        scan = search.keyword_topk(now, query, 15)
        assert ranked(postings.index_topk(spark, path, query, 15, buckets=8)) == ranked(scan)
        keys = ["video_no", "seg_index"]
        found = postings.index_match(spark, path, query, buckets=8).select(*keys).collect()
        assert sorted(map(tuple, found)) == sorted(map(tuple, search.keyword_match(now, query).select(*keys).collect()))

    same(segments)
    for turn in range(2):
        changed = spark.createDataFrame(rows_of(rng, range(20 * turn, 20 * turn + 25)), SEGMENT)
        gone = spark.createDataFrame([(50 + turn,), (1000,)], "video_no long")
        postings.update_index(changed, path, gone, buckets=8, parts=2)
        left = segments.join(changed.select("video_no"), "video_no", "left_anti").join(gone, "video_no", "left_anti")
        segments = left.select(changed.columns).unionByName(changed)
        same(segments)


def test_failed_update_is_not_seen_and_can_be_run_again(spark, tmp, monkeypatch):
    path, old = f"{tmp}/index", spark.createDataFrame([(1, 0, "done", ["a", "b"]), (2, 0, "done", ["a"])], SEGMENT)
    postings.build_index(old, path)
    new = spark.createDataFrame([(1, 0, "done", ["c"]), (3, 0, "done", ["a"])], SEGMENT)
    with monkeypatch.context() as m:
        m.setattr(postings, "_finish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            postings.update_index(new, path)
    videos = lambda q: {r.video_no for r in postings.index_topk(spark, path, q, 9).collect()}
    assert videos("a") == {1, 2} and videos("c") == set()
    postings.update_index(new, path)
    assert videos("a") == {2, 3} and videos("c") == {1} and videos("b") == set()


def test_search_reads_the_buckets_of_its_terms_and_no_text(spark, tmp):
    path = f"{tmp}/index"
    segments = search.with_tokens(spark.createDataFrame([(1, 0, "done", "The cat", "sum", None)], "video_no long, seg_index int, status string, transcript_text string, summary string, topic string"))
    assert segments.first().tokens == ["the", "cat", "sum"]
    postings.build_index(segments, path)
    hits = postings.index_topk(spark, path, "the sum", 5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    buckets = sorted({postings.bucket_of(t) for t in ("the", "sum")})
    assert "PartitionFilters: [bucket" in plan and all(str(b) in plan for b in buckets)
    assert "PushedFilters: [In(gen" in plan or "In(term, [sum,the])" in plan or "In(term, [the,sum])" in plan
    assert "split(" not in plan and "tokens" not in plan
    assert hits.count() == 1


def test_index_of_nothing(spark, tmp):
    path = f"{tmp}/index"
    postings.build_index(spark.createDataFrame([], SEGMENT), path)
    assert postings.index_topk(spark, path, "a", 5).count() == 0
    postings.update_index(spark.createDataFrame([(1, 0, "done", ["a"])], SEGMENT), path)
    assert postings.index_topk(spark, path, "a", 5).where(F.col("score") > 0).count() == 1


def test_tokens_are_counted_in_their_row_by_bounded_batches(spark, monkeypatch):
    rows = [(1, 0, ["b", "a", None, "b"], 4), (1, 1, [], 0), (2, 0, None, -1), (3, 0, ["a"] * 5 + ["b", "été"], 7), (4, 0, ["c"], 1)]
    monkeypatch.setattr(postings, "TOKENS_AT_ONCE", 4)
    kind = pa.schema([("video_no", pa.int64()), ("seg_index", pa.int32()), ("tokens", pa.list_(pa.string())), ("len", pa.int32())])
    batch = pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)
    out = list(postings._term_counts(iter([batch])))
    got = sorted(tuple(r.values()) for b in out for r in b.to_pylist())
    assert got == [("a", 1, 0, 1, 4), ("a", 3, 0, 5, 7), ("b", 1, 0, 2, 4), ("b", 3, 0, 1, 7), ("c", 4, 0, 1, 1), ("été", 3, 0, 1, 7)]
    assert len(out) > 1
    plan = postings._postings(spark.createDataFrame([(1, 0, "done", ["a"])], SEGMENT), 0, 8)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "HashAggregate" not in plan
