"""Hand-worked cases, a plain one-at-a-time model, and heavy keys against light ones."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions.columns import round_even
from reelmill.functions.ordered import find_heavy
from reelmill.functions.span_merges import merge_shortest_first
from reelmill.operators import segmentation as op

SPANS = "video_no long, start_sec double, end_sec double"


def spans(spark, per_video):
    return spark.createDataFrame([(v, float(a), float(b)) for v, s in per_video.items() for a, b in s], SPANS)


def lengths(spark, durations):
    return spark.createDataFrame([(v, float(d)) for v, d in durations.items()], "video_no long, duration_sec double")


def by_video(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.video_no, r.start_sec, r.end_sec)):
        out.setdefault(r.video_no, []).append((r.start_sec, r.end_sec))
    return out


def model_merge(segs, least):
    out = []
    for a, b in segs:
        if out and (b - a < least or out[-1][1] - out[-1][0] < least):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def model_cap(segs, most):
    segs = list(segs)
    while len(segs) > most:
        size = [b - a for a, b in segs]
        i = size.index(min(size))
        left = i > 0 and (i == len(segs) - 1 or size[i - 1] <= size[i + 1])
        j = i - 1 if left else i
        segs[j : j + 2] = [(segs[j][0], segs[j + 1][1])]
    return segs


def random_cuts(rng, n, low=1, high=200):
    at, out = 0, []
    for _ in range(n):
        end = at + rng.randint(low, high)
        out.append((float(at), float(end)))
        at = end
    return out


@pytest.fixture(scope="module")
def library():
    rng = random.Random(5)
    return {v: random_cuts(rng, rng.randint(1, 60)) for v in range(60)}


def test_merge_hand_cases(spark):
    given = {1: [(0, 50), (50, 60)], 2: [(0, 50), (50, 60), (60, 70), (70, 130)], 3: [(0, 5), (5, 9), (9, 80), (80, 90)]}
    assert by_video(op.merge_short(spans(spark, given))) == {
        1: [(0, 60)],
        2: [(0, 70), (70, 130)],
        3: [(0, 90)],
    }


def test_merge_equals_left_fold(spark, library):
    want = {v: model_merge(s, 45) for v, s in library.items()}
    df = spans(spark, library)
    assert by_video(op.merge_short(df)) == want
    assert by_video(op.merge_short(df, heavy=find_heavy(df, ["video_no"], 10, 0))) == want


def test_split_into_three_and_half_even(spark):
    got = by_video(op.split_long(spans(spark, {1: [(0, 300)]}), 100))
    assert got == {1: [(0, 100), (100, 200), (200, 300)]}
    assert len(by_video(op.split_long(spans(spark, {1: [(0, 300)]}), 120))[1]) == 2  # 2.5 rounds to the even 2
    assert by_video(op.split_long(spans(spark, {1: [(0, 300)]}), 0)) == {1: [(0, 300)]}


def test_cap_equals_one_at_a_time(spark, library):
    df = spans(spark, library)
    want = {v: model_cap(s, 5) for v, s in library.items()}
    assert by_video(op.cap_and_cover(df, df, max_segments=5, stretch=False)) == want
    # the same through parallel rounds, with light and with sliced scans
    small = op.shrink_to_fold(df, max_segments=5, fold_limit=20, heavy=None)
    assert small.groupBy("video_no").count().agg(F.max("count")).first()[0] <= 20
    assert by_video(op.cap_and_cover(small, small, max_segments=5, stretch=False)) == want


def test_cap_rounds_over_sliced_videos(spark):
    given = {v: random_cuts(random.Random(v), 45) for v in range(2)}
    df = spans(spark, given)
    small = op.shrink_to_fold(df, max_segments=5, fold_limit=40, heavy=find_heavy(df, ["video_no"], 10, 0))
    got = by_video(op.cap_and_cover(small, small, max_segments=5, stretch=False))
    assert got == {v: model_cap(s, 5) for v, s in given.items()}


def one_after_another(sizes):
    at, out = 0.0, []
    for x in sizes:
        out.append((at, at + x))
        at += x
    return out


SHAPES = {
    "rising": lambda n, rng: range(1, n + 1),
    "falling": lambda n, rng: range(n, 0, -1),
    "saw-tooth": lambda n, rng: [1 + i % 40 for i in range(n)],
    "equal": lambda n, rng: [10] * n,
    "any": lambda n, rng: [rng.randrange(1, 1000) for _ in range(n)],
    "empty ones": lambda n, rng: [rng.choice([0, 0, 0, 1, 2]) for _ in range(n)],
    "nearly all empty": lambda n, rng: [5 if i in (n // 3, n // 2) else 0 for i in range(n)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_cap_in_slices_equals_one_at_a_time_in_few_rounds(spark, monkeypatch, shape):
    rng = random.Random(shape)
    n, rounds = 1500, []
    own = op._level_round
    monkeypatch.setattr(op, "_level_round", lambda *a: rounds.append(1) or own(*a))
    given = {1: one_after_another(SHAPES[shape](n, rng)), 2: one_after_another(SHAPES[shape](90, rng)), 3: [(0.0, 5.0)]}
    df = spans(spark, given).repartition(3)
    small = op.shrink_to_fold(df, max_segments=5, fold_limit=40, slice_spans=256)
    got = by_video(op.cap_and_cover(small, small, max_segments=5, stretch=False))
    assert got == {v: model_cap(s, 5) for v, s in given.items()}
    assert 1 <= len(rounds) <= 2 * math.log2(n)


@pytest.mark.parametrize("seed", range(30))
def test_merges_within_a_slice_are_those_of_the_whole(seed):
    rng = random.Random(seed)
    whole = one_after_another([rng.choice([rng.randrange(1, 9), rng.randrange(1, 60)]) for _ in range(60)])
    start, end = (np.array(x) for x in zip(*whole))
    may = end - start < 2 * (end - start).min()
    every = list(zip(*merge_shortest_first(start, end, may)))
    for low in range(0, 40, 7):
        part = slice(low, low + 20)
        got = zip(*merge_shortest_first(start[part], end[part], may[part], None, low > 0, True))
        for s in got:
            # each span of the slice is one of the whole, or a part of one that isn't merged any further yet
            assert s in every or any(a <= s[0] and s[1] <= b for a, b in every)


def test_twenty_spans_capped_to_five(spark):
    df = spans(spark, {1: [(i * 10, i * 10 + 10) for i in range(20)]})
    assert len(by_video(op.cap_and_cover(df, df, max_segments=5, stretch=False))[1]) <= 5


def test_coverage(spark):
    df = spans(spark, {1: [(0, 40)], 2: [(0, 119.5)], 3: [(0, 40)], 4: [(0, 40)]})
    ends = lengths(spark, {1: 120, 2: 120, 3: 300, 4: 0})
    want = {1: [(0, 120)], 2: [(0, 119.5)], 3: [(0, 150), (150, 300)], 4: [(0, 40)]}
    assert by_video(op.cap_and_cover(df, ends)) == want
    assert by_video(op.cover(df, ends)) == want


def test_finished_segments_are_ordered_and_cover(spark, library):
    durations = {v: s[-1][1] + v * 7 for v, s in library.items()}
    got = by_video(op.finish_segments(spans(spark, library), lengths(spark, durations)))
    for v, segs in got.items():
        assert all(a < b for a, b in segs)
        assert all(x[1] <= y[0] + 1e-9 for x, y in zip(segs, segs[1:], strict=False))
        assert segs[-1][1] >= durations[v] - 1
        assert segs[0][0] == 0


def drops(spark, per_video):
    rows = [(v, i, d) for v, ds in per_video.items() for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "video_no long, window_no long, drop double")


def test_knee_hand_cases(spark):
    given = {
        1: [0.05, 0.06, 0.07, 0.08, 0.5, 0.6],
        2: [0.1, 0.2, 0.3],
        3: [0.1, 0.1, 0.9],
        4: [0.02] * 20 + [0.3, 0.35, 0.9],
        5: [0.4],
        6: [0.2, 0.2, 0.2],
    }
    df = drops(spark, given)
    want = {1: 0.15, 2: 0.25, 3: 0.25, 4: 0.15, 5: 0.25, 6: 0.25}
    assert {r.video_no: r.threshold for r in op.knee_threshold(df).collect()} == want
    heavy = find_heavy(df, ["video_no"], 2, 0)
    assert {r.video_no: r.threshold for r in op.knee_threshold(df, heavy).collect()} == want


def test_knee_is_the_same_for_heavy_videos(spark):
    rng = random.Random(3)
    df = drops(spark, {v: [round(rng.random() ** 3, 4) for _ in range(rng.randint(2, 80))] for v in range(30)})
    light = {r.video_no: r.threshold for r in op.knee_threshold(df, None).collect()}
    sliced = {r.video_no: r.threshold for r in op.knee_threshold(df, find_heavy(df, ["video_no"], 5, 0)).collect()}
    assert light == sliced
    assert any(t not in (0.15, 0.25) for t in light.values())


def windows(spark, per_video):
    rows = [(v, i, i * 30.0, i * 30.0 + 30, e) for v, es in per_video.items() for i, e in enumerate(es)]
    return spark.createDataFrame(
        rows, "video_no long, window_no long, start_sec double, end_sec double, embedding array<float>"
    ).withColumn("text", F.lit("words"))


def test_voiced_alternating_vectors(spark):
    w = windows(spark, {1: [[1.0, 0.0], [0.0, 1.0]] * 3, 2: [[1.0, 0.0]]})
    got = by_video(op.segment_voiced(w, lengths(spark, {1: 180, 2: 25, 3: 70})))
    assert got[1][0][0] == 0 and got[1][-1][1] == 180
    assert got[2] == [(0, 25)] and got[3] == [(0, 70)]


def test_voiced_heavy_equals_light(spark):
    rng = random.Random(9)
    w = windows(spark, {v: [[rng.random(), rng.random()] for _ in range(rng.randint(1, 200))] for v in range(6)})
    ends = lengths(spark, {v: 9000 for v in range(6)})
    light = by_video(op.segment_voiced(w, ends, heavy=None))
    sliced = by_video(op.segment_voiced(w, ends, fold_limit=48, heavy=find_heavy(w, ["video_no"], 20, 0)))
    assert light == sliced


def test_silent_runs(spark):
    rows = [(1, 0, 5.0, "a"), (1, 1, 60.0, "a"), (1, 2, 120.0, None), (1, 3, 125.0, None), (1, 4, 150.0, "b")]
    frames = spark.createDataFrame(rows, "video_no long, frame_no long, time_sec double, scene string")
    videos = lengths(spark, {1: 180, 2: 33})
    runs = sorted((r.start_sec, r.end_sec, r.scene) for r in op.scene_runs(frames, videos).where("video_no = 1").collect())
    assert runs == [(0, 120, "a"), (120, 150, None), (150, 180, "b")]
    assert by_video(op.segment_silent(frames, videos)) == {1: [(0, 90), (90, 180)], 2: [(0, 33)]}


def test_attach(spark):
    segs = spark.createDataFrame(
        [(1, 0, 0.0, 60.0), (1, 1, 60.0, 400.0), (2, 0, 0.0, 60.0)], "video_no long, seg_index int, start_sec double, end_sec double"
    )
    lines = spark.createDataFrame(
        [(1, 0, 0.0, 5.0, "one"), (1, 1, 59.9, 61.0, "two"), (1, 2, 60.0, 61.0, "three"), (1, 3, 390.0, 391.0, "four")],
        "video_no long, line_no int, start_sec double, end_sec double, text string",
    )
    got = {(r.video_no, r.seg_index): r.text for r in op.attach_transcript(segs, lines).collect()}
    assert got == {(1, 0): "one two", (1, 1): "three four", (2, 0): ""}
    frames = spark.createDataFrame(
        [
            (1, 0, 1.0, "b", ["x", "a"], "hi", "c1"),
            (1, 1, 2.0, "a", ["x"], "", ""),
            (1, 2, 59.0, "", [], "there", "c2"),
            (1, 3, 60.0, "z", ["q"], "no", "c3"),
        ],
        "video_no long, frame_no long, time_sec double, scene string, objects array<string>, ocr string, caption string",
    )
    r = op.attach_frame_signals(segs, frames).where("video_no = 1 AND seg_index = 0").first()
    assert (r.scenes, r.objects, r.ocr, r.captions) == (["a", "b"], ["a", "x"], "hi there", ["c1", "c2"])

    # overfull buckets, dealt over parts, give the same
    def full(df, at):
        return find_heavy(df.withColumn("bucket", F.floor(F.col(at) / 120)), ["video_no", "bucket"], 1, 0)

    salted = op.attach_frame_signals(segs, frames, full(frames, "time_sec"))
    assert set(map(str, salted.collect())) == set(map(str, op.attach_frame_signals(segs, frames, None).collect()))
    texts = op.attach_transcript(segs, lines, full(lines, "start_sec"))
    assert {(r.video_no, r.seg_index): r.text for r in texts.collect()} == got


def test_cap_with_spans_of_no_length(spark):
    spans = [(1, 10.0 * i, 10.0 * (i + 1)) for i in range(60)] + [(1, 300.0, 300.0)] + [(2, 5.0, 5.0)] * 30 + [(2, 5.0, 9.0)] * 3
    df = spark.createDataFrame(spans, "video_no long, start_sec double, end_sec double")
    got = op.shrink_to_fold(df, max_segments=5, fold_limit=20)
    counts = {r.video_no: r["count"] for r in got.groupBy("video_no").count().collect()}
    assert 5 <= counts[1] <= 20 and 5 <= counts[2] <= 20
    assert got.where("video_no = 1").agg(F.min("start_sec"), F.max("end_sec")).first()[:] == (0.0, 600.0)


def test_bounds_next_to_a_half_are_rounded_as_in_sql(spark):
    got = by_video(op.cover(spans(spark, {1: [(0, 150), (150, 300)]}), lengths(spark, {1: 362.6875})))
    assert got[1] == [(0.0, 150.0), (150.0, 256.35), (256.35, 362.69)]
    values = [k / 200 for k in range(-60_000, 60_000, 7)] + [k / 80 for k in range(20_001)] + [1e308, -1e308, float("inf"), -0.001, None]
    rounded = spark.createDataFrame([(x,) for x in values], "x double").select("x", round_even(F.col("x"), 2).alias("y")).collect()
    want = duckdb.execute("SELECT round_even(unnest(?::DOUBLE[]), 2)", [[r.x for r in rounded]]).fetchall()
    assert [r.y for r in rounded] == [y for (y,) in want]
