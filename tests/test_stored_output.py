"""Stage output that a second run takes up, percentiles from sketches, documents with all fields, keyphrases by a caller's embedder."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelmill.functions import phrases
from reelmill.functions.columns import dot
from reelmill.functions.vectors import digest_embedder
from reelmill.operators import jobs, maintenance, rollup, text

SEGMENT = "video_no long, seg_index int, summary string, transcript_text string, topic string, embedding array<float>"


def test_a_stopped_run_is_taken_up_and_the_model_sees_no_stored_row_again(spark, tmp):
    rows = [(v, s, f"text {v} {s}", None, None, [0.5, 0.5] if v % 4 == 0 else None) for v in range(20) for s in range(2)]
    segments = spark.createDataFrame(rows, SEGMENT)
    seen, rounds, stop_after = spark.sparkContext.accumulator(0), [0], [3]

    def embed(df, column):
        if df.limit(1).count():
            rounds[0] += 1
            if rounds[0] > stop_after[0]:
                raise RuntimeError("lost")

        @F.udf("array<float>")
        def model(x):
            seen.add(1)
            return [float(len(x)), 1.0]

        return df.withColumn("embedding", model(column))

    with pytest.raises(RuntimeError):
        maintenance.reembed_resumable(segments, embed, 2, f"{tmp}/out", rounds=8)
    first = seen.value
    assert 0 < first < 30
    stop_after[0] = 10**6
    got = maintenance.reembed_resumable(segments, embed, 2, f"{tmp}/out", run=1, rounds=8).collect()
    assert seen.value == 30  # every missing vector once, over both runs
    want = {(v, s): e or [float(len(t)), 1.0] for v, s, t, _, _, e in rows}
    assert {(r.video_no, r.seg_index): r.embedding for r in got} == want and len(got) == 40
    maintenance.reembed_resumable(segments, embed, 2, f"{tmp}/out", run=2, rounds=8).collect()
    assert seen.value == 30


def test_reuse_tells_stored_output_from_fresh(spark, tmp):
    items = spark.createDataFrame([(i, i * i) for i in range(9)], "k long, x long")
    double = lambda df: df.select("k", (F.col("x") * 2).alias("y"))
    assert {r.reused for r in jobs.reuse_stage_output(items.where("k < 4"), f"{tmp}/o", double, "k").collect()} == {False}
    got = jobs.reuse_stage_output(items.where("k > 1"), f"{tmp}/o", double, "k", run=1, rounds=3).collect()
    assert {(r.k, r.y, r.reused) for r in got} == {(i, 2 * i * i, i < 4) for i in range(2, 9)} and len(got) == 7


def test_percentiles_are_within_one_percent_and_merge(spark):
    rng = random.Random(4)
    rows = [("a", rng.randrange(10**13), rng.lognormvariate(1, 2)) for _ in range(3000)] + [("b", 5, 0.0), ("b", 6, None), ("b", 7, -1.0), ("c", 1, 3600.0)]
    events = spark.createDataFrame(rows, "stage string, us long, seconds double")
    sketch = jobs.timing_sketch(events)
    assert sketch.groupBy("stage", "day").count().agg(F.max("count")).first()[0] < 1500
    halves = jobs.merge_sketches(*[jobs.timing_sketch(events.where(F.col("us") % 2 == k)) for k in (0, 1)])
    got = {r.stage: r for r in jobs.sketch_percentiles(halves, (0.5, 0.95, 0.99)).collect()}
    assert got == {r.stage: r for r in jobs.sketch_percentiles(sketch, (0.5, 0.95, 0.99)).collect()}
    values = sorted(x for s, _, x in rows if s == "a")
    for share, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        exact = values[-(-int(share * 100) * len(values) // 100) - 1]
        assert abs(got["a"][name] - exact) <= 0.011 * exact + 1e-4
    assert (got["b"].n, got["b"].p95) == (2, 0.0) and abs(got["c"].p50 - 3600) <= 37
    per_day = jobs.sketch_percentiles(sketch, keys=("stage", "day"))
    assert per_day.agg(F.sum("n")).first()[0] == 3003


def test_documents_have_their_provenance(spark):
    videos = spark.createDataFrame(
        [(1, "0123456789", 12.345, {"os": "linux", "gpu": "x"}), (2, "abc", None, None)], "video_no long, video_id string, duration_sec double, runtime map<string,string>"
    )
    segments = spark.createDataFrame(
        [(1, 0, 0.04, 9.96, "t", "s", "g", "expert", ["x"], 0.5, "demo")],
        "video_no long, seg_index int, start_sec double, end_sec double, topic string, subject string, grade_level string, difficulty string, "
        "tags array<string>, confidence double, content_type string",
    )
    timings = spark.createDataFrame([(1, "llm", 1.006), (1, "llm", 2.0), (1, "visual", 0.5)], "video_no long, stage string, seconds double")
    one, two = rollup.export_documents(videos, segments, timings).orderBy("video_no").collect()
    assert (one.id8, one.duration_sec, one.os, one.gpu, one.python, one.pipeline_time_sec) == ("01234567", 12.34, "linux", "x", None, 3.5)
    assert one.stage_timings == {"llm": 3.01, "visual": 0.5} and one.segments[0].content_type == "demo"
    assert (two.id8, two.duration_sec, two.segment_count, two.os, two.stage_timings) == ("abc", 0.0, 0, None, None)


def test_phrases_nearest_to_the_text_by_the_callers_embedder(spark):
    calls = []

    def embed(df, keys, column):
        calls.append(sorted(r[0] for r in df.select(keys[0]).collect()))
        return df.withColumn("embedding", F.array(F.length(column).cast("double"), F.lit(1.0)))

    docs = spark.createDataFrame([(1, "the green tree of x"), (2, "green"), (3, ""), (4, None)], "doc_id long, text string")
    got = text.keyphrases_by_embedding(docs, top=2, embedder=embed).orderBy("doc_id", "place").collect()
    assert [(r.doc_id, r.phrase) for r in got] == [(1, "green tree"), (1, "green"), (2, "green")]
    assert calls[0] == ["green", "green tree", "tree"]  # each once
    assert got[2].score == 1.0


def test_phrases_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(text, "PHRASE_ROWS", 50)
    texts = pd.DataFrame({"doc_id": range(100), "tokens": [" ".join(f"w{d}x{i}" for i in range(10)) for d in range(100)]})
    out = list(text._phrase_rows("doc_id", None)(iter([texts])))
    assert sum(map(len, out)) == 100 * 19 and max(map(len, out)) < 50 + 19
    assert set(pd.concat(out)["doc_id"]) == set(range(100))


def test_digest_vectors_are_made_in_the_row_of_the_text(spark):
    docs = spark.createDataFrame([(1, "Lion tiger, lion"), (2, ""), (3, None)], "doc_id long, text string")
    made = digest_embedder(docs, ["doc_id"], "text")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.embedding for r in made.collect()}
    assert sorted(x for x in got[1] if x) == pytest.approx([1 / 5**0.5, 2 / 5**0.5]) and got[2] == got[3] == [0.0] * 64


def test_phrases_nearest_by_digest_are_found_in_the_row_of_the_text(spark):
    rng = random.Random(5)
    words = ["the", "x", "é", "éa", "a1", "lion", "Tiger", "bear", "longest" * 6, *(f"w{i}" for i in range(300))]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 30, 400]))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (90, None), (91, " -- "), (92, ", lion;lion ")], "doc_id long, text string")
    made = text.keyphrases_by_embedding(docs, top=7)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    joined = text.keyphrases_by_embedding(docs, top=7, embedder=lambda *a: digest_embedder(*a))
    assert made.dtypes == joined.dtypes
    got = sorted(map(tuple, made.collect()))
    assert got == sorted(map(tuple, joined.collect())) and {d for d, *_ in got} > {92}


def test_keyphrases_ask_by_blocks_and_no_pair_of_text_and_phrase_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(text, "BLOCK_BYTES", 400)
    rng = random.Random(7)
    words = ["the", "of", "é", "x", "lion", "Tiger", "long" * 12, *(f"w{i}" for i in range(60))]
    rows = [(k % 45, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 9, 80])))) for k in range(50)] + [(90, None), (None, "lion w1 w2"), (None, "w2 lion"), (91, "the - of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = text.keyphrases(docs, top=6)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "phrase" in line]
    assert made.dtypes == [("doc_id", "bigint"), ("phrase", "string"), ("score", "double"), ("place", "int")]
    stop = set(text.STOP_WORDS)
    counts = [text._counts([w for w in re.split("[^a-zé0-9]+", (t or "").lower()) if w and w not in stop]) for _, t in rows]
    df = Counter(p for c in counts for p in c)
    want = Counter()
    for key in {k for k, _ in rows}:
        mine = [(p, round_6(n / sum(c.values()) * math.log((len(rows) + 1) / (df[p] + 1)))) for (k, _), c in zip(rows, counts, strict=True) if k == key for p, n in c.items()]
        want.update((key, p, score, place) for place, (p, score) in enumerate(sorted(mine, key=lambda x: (-x[1], x[0]))[:6], start=1))
    assert Counter(map(tuple, made.collect())) == want
    none = spark.createDataFrame([(1, None), (2, "the")], "doc_id long, text string")
    assert text.keyphrases(none).collect() == text.keyphrases(none.where("doc_id > 2")).collect() == []


def round_6(x):
    return float(np.round(x, 6))


def test_document_frequencies_are_told_apart_by_both_hashes():
    wide, narrow = np.array([9, 5, 9, 9, 1 << 63, 9, 5], np.uint64), np.array([1, 0, 2, 1, 3, 2, 0], np.uint16)
    assert phrases.sum_by_key(wide, narrow, np.arange(1, 8, dtype=np.uint64)).tolist() == [5, 9, 9, 5, 5, 9, 9]
    assert phrases.from_planes(phrases.planes(wide), "<u8").tolist() == wide.tolist()
    a, b = (phrases.Phrases(phrases.Words(pa.array(t))) for t in (["b a b", "c"], ["z", "b a", "a b"]))
    hashes = [dict(zip(x.strings(np.arange(len(x.first))).to_pylist(), zip(*(h.tolist() for h in x.hashed()), strict=True), strict=True)) for x in (a, b)]
    assert sorted(hashes[0]) == ["a b", "b a"] and hashes[0]["a b"] == hashes[1]["a b"] and hashes[0]["b a"] == hashes[1]["b a"] != hashes[0]["a b"]


def test_texts_are_gone_over_in_slices(monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 1000)
    batch = pa.record_batch({"doc_id": range(7), "tokens": ["a" * n for n in (0, 400, 5, 2000, 0, 0)] + [None]})
    made = list(phrases.text_slices(batch, "tokens"))
    assert [b.column("doc_id").to_pylist() for b, _ in made] == [[0, 1], [2], [3], [4, 5, 6]]
    assert [x for _, t in made for x in t.to_pylist()] == [x or "" for x in batch.column("tokens").to_pylist()]


def test_best_rows_of_each_group_keep_the_order_of_ties():
    rng = np.random.default_rng(4)
    group = np.sort(rng.integers(0, 9, 3000))
    group = group[np.concatenate([np.flatnonzero(group == 4)[:3], np.flatnonzero(group != 4)])]
    group.sort()
    score = rng.integers(0, 40, len(group)) / 8
    rows, place = phrases.best_rows(group, score, 5)
    want = [(int(r), k) for g in range(9) for k, r in enumerate(sorted(np.flatnonzero(group == g), key=lambda r: (-score[r], r))[:5], start=1)]
    assert list(zip(rows.tolist(), place.tolist(), strict=True)) == want
    assert not len(phrases.best_rows(group[:0], score[:0], 5)[0])


def test_sparse_product_equals_the_whole_one(spark):
    rows = [([0.0, 0.6, 0.0, -0.8], [0.1, 0.2, 0.3, 0.4]), ([0.0, 0.0], [1.0, 2.0]), ([3.0, None], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = df.select(text._sparse_dot(text._sparse(F.col("a")), F.col("b")).alias("x"), dot(F.col("a"), F.col("b")).alias("y")).collect()
    assert [r.x for r in got] == [r.y for r in got]


def test_window_vectors_need_no_shuffle_of_tokens(spark):
    import __spark_entry__ as project

    plan = project.queries()["window_embedding"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "slot" in plan
    assert not [line for line in plan.splitlines() if ("Aggregate" in line or "Exchange" in line) and "slot" in line]
