"""Hand-worked cases of catalogue, tag, search, frame and source operators."""

import hashlib
import json
import os
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions import vectors as vec
from reelmill.functions.columns import safe_stem, stable_uuid
from reelmill.functions.ordered import Ordered, find_heavy, ordered_scan
from reelmill.operators import browse, catalog, frames, jobs, maintenance, rollup, search, speech, tags, text
from reelmill.sources import documents, files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- ordered scans -----------------------------------------------------------


def test_heavy_and_plain_scans_agree(spark):
    rng = random.Random(2)
    data = [(0 if rng.random() < 0.5 else rng.randint(1, 20), i, rng.choice([None, 1, 2, 3])) for i in range(600)]
    df = spark.createDataFrame(data, "k long, t long, v long")
    outs = [
        Ordered("rn", "row_number"), Ordered("s", "sum", F.col("v")), Ordered("lag", "lag", F.col("v")),
        Ordered("lead", "lead", F.col("v")), Ordered("last", "last", F.col("v")), Ordered("n", "count_all"),
        Ordered("lo", "min_all", F.col("t")), Ordered("hi", "max_all", F.col("t")),
    ]

    def scan(heavy):
        return Counter(map(tuple, ordered_scan(df, ["k"], [F.col("t")], F.floor(F.col("t") / 25), outs, heavy).collect()))

    heavy = find_heavy(df, ["k"], 100, 0)
    assert [r.k for r in heavy.collect()] == [0]
    assert scan(heavy) == scan(None)
    assert find_heavy(df, ["k"], 1000, 0) is None


# --- catalogue ---------------------------------------------------------------


def test_files_are_found_and_identified(spark, tmp):
    os.makedirs(f"{tmp}/a/b")
    for name, body in (("a/x.mp4", b"same"), ("a/b/y.MKV", b"same"), ("a/z.txt", b"no"), ("a/w.mov", b"other")):
        with open(f"{tmp}/{name}", "wb") as f:
            f.write(body)
    found = files.discover_folder(spark, tmp)
    assert [os.path.basename(p) for (p,) in rows(found, "source_path")] == ["y.MKV", "w.mov", "x.mp4"]
    known = {os.path.basename(r.source_path): r for r in files.identify(spark, found, tmp).collect()}
    assert known["x.mp4"].content_hash == known["y.MKV"].content_hash == hashlib.sha256(b"same").hexdigest()
    assert known["w.mov"].content_hash != known["x.mp4"].content_hash
    assert known["x.mp4"].video_id == str(uuid.uuid5(uuid.NAMESPACE_URL, known["x.mp4"].source_path))
    glob = files.discover_glob(spark, f"{tmp}/a/*.mp4")
    assert [os.path.basename(p) for (p,) in rows(glob, "source_path")] == ["w.mov", "x.mp4"]


@pytest.mark.parametrize(
    "spec, want",
    [
        ("all", ["/v/a.mp4", "/v/ab.mp4", "/v/c.mov"]), ("first", ["/v/a.mp4"]), (2, ["/v/ab.mp4"]), ("9", []), ("0", []),
        ("a.mp4", ["/v/a.mp4"]), ("b.mp", ["/v/ab.mp4"]), (["C.MOV", 1], ["/v/a.mp4", "/v/c.mov"]), ("zzz", []),
    ],
)
def test_selection(spark, spec, want):
    paths = spark.createDataFrame([("/v/c.mov",), ("/v/ab.mp4",), ("/v/a.mp4",)], "source_path string")
    assert [p for (p,) in rows(catalog.select_by_spec(paths, spec), "source_path")] == want


def test_selection_keeps_first_choice_order(spark):
    paths = spark.createDataFrame([("/v/c.mov",), ("/v/a.mp4",)], "source_path string")
    assert rows(catalog.select_by_spec(paths, "c, 1, all"), "selector_no", "source_path") == [(0, "/v/c.mov"), (1, "/v/a.mp4")]


def test_verdict_with_force_and_missing_hash(spark):
    cols = "video_id string, source_path string, content_hash string, file_size_bytes long, status string, is_duplicate boolean, created_s long"
    stored = spark.createDataFrame(
        [("a", "/a", "h", 1, "done", False, 1), ("b", "/b", "h", 1, "done", True, 2), ("c", "/c", "", 1, "failed", False, 3)], cols
    )
    got = {r.video_id: r for r in catalog.register_verdict(stored, stored).collect()}
    assert [got[v].verdict for v in "abc"] == ["exists", "duplicate", "queued"]
    assert got["b"].canonical_video_id == "a"
    forced = {r.video_id: r.verdict for r in catalog.register_verdict(stored, stored, force=True).collect()}
    assert forced == {"a": "queued", "b": "duplicate", "c": "queued"}


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", "failed", 1)], "video_id string, status string, created_s long")
    new = spark.createDataFrame([("a", "done", 9), ("b", "done", 9)], old.schema)
    once = catalog.upsert_latest(old, new)
    assert rows(once, "video_id", "status", "created_s") == [("a", "done", 1), ("b", "done", 9)]
    assert rows(catalog.upsert_latest(once, new), *old.columns) == rows(once, *old.columns)


def test_stems(spark):
    df = spark.createDataFrame([("/x/a b!.mp4",), ("/x/__.mp4",), ("/x/.hidden",), ("/x/plain",)], "p string")
    got = df.select(safe_stem(F.col("p"), F.lit("12345678-aa")).alias("s")).collect()
    assert [r.s for r in got] == ["a_b", "results_12345678", ".hidden", "plain"]


def test_documents_round_trip(spark, tmp):
    docs = spark.createDataFrame(
        [("id1", "/a/x.mp4", 1.5), ("id2", "/b/x.mp4", 2.5), ("id3", "/c/y.mp4", 3.5)], "video_id string, source_path string, duration_sec double"
    )
    documents.write_documents(docs.where("video_id <> 'id3'"), f"{tmp}/out")
    documents.write_documents(docs.where("video_id = 'id3'"), f"{tmp}/out")  # a later batch keeps the earlier documents
    back = documents.read_documents(spark, f"{tmp}/out", docs.schema)
    assert rows(back, "video_id") == [("id2",), ("id3",)]  # x.mp4 twice: one stem, one file
    with open(f"{tmp}/out/all_results.json", "w") as f:
        f.write(json.dumps({"video_id": "ignored"}))
    assert documents.read_documents(spark, f"{tmp}/out", docs.schema).count() == 2


# --- route and frames ----------------------------------------------------------


def test_route_boundary(spark):
    data = [(1, True, -20.0, 3.0), (2, True, -20.0, 2.99), (3, False, -99.0, 42.0), (4, True, -20.0, 0.0)]
    v = spark.createDataFrame(data, "video_no long, has_speech boolean, mean_level_db double, speech_sec double")
    assert rows(speech.route_videos(v), "video_no", "path") == [(1, "voice"), (2, "silent"), (3, "silent"), (4, "silent")]


def test_frame_plan(spark):
    v = spark.createDataFrame([(1, 100.0, 5), (2, 0.0, 5)], "video_no long, duration_sec double, max_frames int")
    cuts = spark.createDataFrame([(1, float(t), 0.9) for t in range(50)] + [(1, 99.0, 0.1)], "video_no long, time_sec double, score double")
    anchors = {round(100 * i / 5, 2) for i in range(1, 5)}
    times = sorted(anchors | {float(t) for t in range(50)})
    want = [times[int(i * (len(times) / 5))] for i in range(5)]
    assert [t for _, t in rows(frames.plan_frame_times(v, cuts).where("video_no = 1"), "video_no", "time_sec")] == want
    assert rows(frames.plan_frame_times(v, cuts).where("video_no = 2"), "time_sec") == [(0.0,)]


def test_gated_model_sees_gated_rows_only(spark):
    df = spark.createDataFrame([(1, True), (2, False)], "frame_no long, run_detector boolean")

    def model(batches):
        for b in batches:
            yield b[["frame_no"]].assign(hits=len(b))

    got = frames.run_model_on(df, "run_detector", model, "frame_no long, hits long", ["frame_no"])
    assert rows(got.fillna(0), "frame_no", "hits") == [(1, 1), (2, 0)]


# --- tags ------------------------------------------------------------------------

CLEAN = '{"topic": "T", "tags": ["a", "b"], "confidence": 0.876, "mood": "x"}'


@pytest.mark.parametrize(
    "raw, status, topic, tag_list",
    [
        (CLEAN, "strict", "T", ["a", "b"]),
        (f"```json\n{CLEAN}\n```", "strict", "T", ["a", "b"]),
        (CLEAN + " trailing words", "strict", "T", ["a", "b"]),
        ('{"topic": "T", "tags": ["a", "b"]', "strict", "T", ["a", "b"]),
        ('{"topic": "T', "strict", "T", []),
        ('{"topic": "T", "tags": ["a", " b "], "confi', "recovered", "T", ["a", " b "]),  # blanks outside the quotes only
        (CLEAN + CLEAN, "recovered", "T", ["a", "b"]),
        ("{'topic': 'T'}", "error", None, None),
        ("no json here", "error", None, None),
        ("", "error", None, None),
        (None, "error", None, None),
    ],
)
def test_parsing(spark, raw, status, topic, tag_list):
    df = spark.createDataFrame([(1, 0, False, raw, None)], "video_no long, seg_index int, is_silent boolean, raw_1 string, raw_2 string")
    r = tags.tag_answers(df).first()
    assert (r.status, r.topic, r.tags) == (status, topic, tag_list)
    if status == "error":
        assert r.confidence is None and r.error == (raw[:300] if raw is not None else None)


def test_confidence_rules(spark):
    def one(value, silent):
        raw = '{"topic": "T", "confidence": %s}' % value
        df = spark.createDataFrame([(1, 0, silent, raw, None)], "video_no long, seg_index int, is_silent boolean, raw_1 string, raw_2 string")
        r = tags.tag_answers(df).first()
        return r.confidence, r.confidence_defaulted

    assert one("0.876", False) == (0.88, False)
    assert one('"0.5"', False) == (0.5, False)
    assert one('"high"', False) == (0.7, True)
    assert one("null", True) == (0.5, True)
    assert one("0.95", True) == (0.6, False)


def test_dominant_value_ties(spark):
    data = [
        (1, 0, "Chem", "9", 0.5), (1, 1, "Chem", "9", 0.5), (1, 2, "Math", "7", 0.9),
        (2, 0, "A", "1", 0.2), (2, 1, "B", "1", 0.9), (2, 2, "C", "", 0.9), (2, 3, "", "", 1.0),
        (3, 0, "A", "1", 0.1), (3, 1, "A", "1", 0.1), (3, 2, "B", "1", 0.1), (3, 3, "B", "1", 0.1), (3, 4, "C", "1", 0.9),
    ]
    s = spark.createDataFrame(data, "video_no long, seg_index int, subject string, grade_level string, confidence double")
    s = s.withColumns({"start_sec": F.lit(0.0), "end_sec": F.lit(1.0)})
    got = {r.video_no: r.dominant_subject for r in tags.dominant_value(s).collect()}
    assert got == {1: "Chem", 2: "B", 3: "C"}  # a shared top count hands over to the most confident segment of all
    fixed = rows(tags.consistency_pass(s).where("video_no = 1 AND seg_index = 2"), "subject", "subject_raw", "grade_level", "grade_level_raw")
    assert fixed == [("Chem", "Math", "9", "7")]
    blank = rows(tags.consistency_pass(s).where("video_no = 2 AND seg_index = 3"), "subject", "grade_level")
    assert blank == [("", "")]


def test_rule_tagger_titles_and_default(spark):
    data = [(1, 0, False, "don't well-known x two Words", "", []), (1, 1, True, "spoken", "", []), (1, 2, True, "", "screen Line\nnext", [])]
    s = spark.createDataFrame(data, "video_no long, seg_index int, is_silent boolean, text string, ocr string, captions array<string>")
    assert rows(tags.rule_tagger(s), "seg_index", "topic") == [(0, "Don'T Well-Known Two Words"), (1, "Sample Lesson"), (2, "Screen Line")]


# --- rollup and browse --------------------------------------------------------------


def test_long_videos_come_in_parts(spark):
    n = 503
    s = spark.range(n).select(F.lit(1).alias("video_no"), F.col("id").cast("int").alias("seg_index"))
    assert len(rollup.nested_segments(s, [F.col("seg_index")]).first().segments) == n
    got = rollup.nested_segments(s, [F.col("seg_index")], part_segments=500).orderBy("part_no").collect()
    assert [len(r.segments) for r in got] == [n - 3, 3]
    assert [x.seg_index for r in got for x in r.segments] == list(range(n))


def test_difficulty_and_primary_ties(spark):
    data = [(1, 0, 0.0, 10.0, "t0", "odd", ["x", "", "y"]), (1, 1, 10.0, 20.0, None, "beginner", ["y"]), (1, 2, 20.0, 25.0, "t2", "", [])]
    s = spark.createDataFrame(data, "video_no long, seg_index int, start_sec double, end_sec double, topic string, difficulty string, tags array<string>")
    s = s.withColumns({"subject": F.lit(""), "grade_level": F.lit(None).cast("string"), "confidence": F.lit(0.5)})
    r = rollup.video_rollup(s).first()
    assert (r.difficulty, r.primary_topic, r.topics, r.all_tags, r.subject, r.grade) == ("odd", "t0", ["t0", "t2"], ["x", "y"], None, None)


def test_page_count_of_size_zero(spark):
    assert browse.list_total(spark.range(3), 0).first().pages == 0
    assert browse.list_total(spark.range(51), 25).first().pages == 3


# --- search ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def segments(spark):
    rng = np.random.default_rng(4)
    data = [(i, 0, "soft_deleted" if i == 3 else "done", rng.normal(size=8).tolist(), ["the", "cat"] if i % 2 else ["cat", "cat"]) for i in range(80)]
    data.append((99, 0, "done", [0.0] * 8, ["dog"]))
    data.append((98, 0, "done", None, ["dog"]))
    return spark.createDataFrame(data, "video_no long, seg_index int, status string, embedding array<float>, tokens array<string>")


def brute(segments, q, k):
    out = []
    for r in segments.collect():
        if r.status != "soft_deleted" and r.embedding and any(r.embedding):
            e = np.array(r.embedding, dtype=float)
            out.append((-round(float(e @ q / np.linalg.norm(e) / np.linalg.norm(q)), 6), r.video_no))
    return [v for _, v in sorted(out)[:k]]


def test_semantic_equals_brute_force(segments):
    q = np.arange(8) - 3.0
    got = [r.video_no for r in search.semantic_topk(segments, q, 7).collect()]
    assert got == brute(segments, q, 7)


def test_batch_equals_single(spark, segments):
    qs = [[1.0] * 8, [float(i) for i in range(8)], [-1.0, 2.0] * 4]
    queries = spark.createDataFrame(list(enumerate(qs)), "query_no long, vector array<double>")
    got = {}
    for r in search.semantic_topk_batch(segments.repartition(5), queries, 6).orderBy("query_no", "place").collect():
        got.setdefault(r.query_no, []).append(r.video_no)
    assert got == {i: brute(segments, np.array(q), 6) for i, q in enumerate(qs)}


def test_ann_with_all_lists_is_exact(segments):
    q = [1.0, -1.0] * 4
    lists, centroids = search.inverted_lists(segments, 5)
    exact = search.semantic_topk(segments, q, 10)
    full = search.ann_topk(lists, centroids, q, 10, probes=5)
    assert [r.video_no for r in full.collect()] == [r.video_no for r in exact.collect()]
    assert search.recall_at_k(full, exact, 10).first().recall == 1.0
    assert 0 <= search.recall_at_k(search.ann_topk(lists, centroids, q, 10, probes=1), exact, 10).first().recall <= 1


def test_keyword_needs_every_term(segments):
    assert {r.video_no for r in search.keyword_match(segments, "The, CAT!").collect()} == {i for i in range(80) if i % 2 and i != 3}
    assert search.keyword_match(segments, "?!").count() == 0
    assert search.keyword_topk(segments, "...", 5).count() == 0


def test_fusion_prefers_hits_of_both_lists(segments):
    q = [1.0] * 8
    fused = search.hybrid_rrf(segments, "the cat", q, 10).collect()
    assert all(fused[i].score >= fused[i + 1].score for i in range(9))
    both = [r for r in fused if r.sem_rank and r.kw_rank]
    assert both and fused[0].score > 1 / 61


def test_dispatch_degrades_to_keyword(segments):
    modes = {m: {r["mode"] for r in search.search(segments, "cat", m, 5, v).collect()} for m, v in (("hybrid", None), ("odd", [1.0] * 8))}
    assert modes == {"hybrid": {"keyword"}, "odd": {"semantic"}}


def test_gate(spark):
    hits = spark.createDataFrame([(1, 0.9), (2, 0.7), (3, 0.6)], "video_no long, score double")
    assert rows(search.relevance_gate(hits), "video_no") == [(1,), (2,)]
    assert search.relevance_gate(hits, min_score=0).count() == 3
    low = spark.createDataFrame([(1, 0.1)], "video_no long, score double")
    assert search.relevance_gate(low).count() == 0 and search.relevance_gate(low, semantic=False).count() == 1


# --- jobs, text, vectors ------------------------------------------------------------------


def test_job_fold(spark):
    data = [
        (1, 1, 10, "start", 0.0, None), (1, 2, 20, "route", 1.5, None), (1, 3, 30, "failed", 0.0, ["E", "F"]),
        (1, 4, 40, "start", 0.0, None), (1, 5, 50, "llm", 2.5, None), (2, 6, 5, "start", 0.0, None), (2, 7, 6, "done", 0.0, None),
    ]
    ev = spark.createDataFrame(data, "job_no long, event_id long, us long, stage string, seconds double, error_chain array<string>")
    got = {r.job_no: r for r in jobs.job_state(ev).collect()}
    assert (got[1].state, got[1].current_stage, got[1].attempts, got[1].last_stage_seconds, got[1].error) == ("processing", "llm", 2, 2.5, "E <- F")
    assert (got[2].state, got[2].current_stage, got[2].error) == ("done", "done", None)
    heavy = find_heavy(ev, ["job_no"], 3, 0)
    assert rows(jobs.state_transitions(ev, heavy), "job_no", "event_id") == rows(jobs.state_transitions(ev, None), "job_no", "event_id")


def test_phrase_counts_equal_brute_force(spark):
    docs = spark.createDataFrame([(1, "A b a B, a"), (2, ""), (3, "Éa x" * 3)], "doc_id long, text string")
    got = {(r.doc_id, r.phrase): r.score for r in text.keyword_share(docs).collect()}
    assert got[(1, "a b")] == round(2 / 4, 3)
    assert {d for d, _ in got} == {1, 3}
    ranked = text.keyphrases(spark.createDataFrame([(1, "the lion lion"), (2, "the tiger"), (3, "the bear")], docs.schema))
    top = {r.doc_id: r.phrase for r in ranked.where("place = 1").collect()}
    assert top[1] in ("lion", "lion lion") and not any(r.phrase == "the" for r in ranked.collect())


def test_keyphrases_equal_brute_force(spark):
    from pyspark.ml.feature import StopWordsRemover

    words = {1: "lion tiger lion bear", 2: "tiger the tiger and bear", 3: "wolf bear lion wolf wolf", 4: "bear"}
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    counts = {}
    for d, t in words.items():
        kept = [w for w in t.split() if w not in stop]
        counts[d] = Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:], strict=False)])
    df = Counter(p for c in counts.values() for p in c)
    want = {}
    for d, c in counts.items():
        for p, n in c.items():
            want[(d, p)] = round(n / sum(c.values()) * float(np.log((len(words) + 1) / (df[p] + 1))), 6)
    docs = spark.createDataFrame(list(words.items()), "doc_id long, text string")
    got = text.keyphrases(docs).collect()
    assert {(r.doc_id, r.phrase): r.score for r in got} == pytest.approx(want)
    for d in words:
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.place)
        assert [(-r.score, r.phrase) for r in mine] == sorted((-r.score, r.phrase) for r in mine)


def test_hashing_embedder_and_reembedding(spark):
    cols = "video_no long, summary string, transcript_text string, topic string, embedding array<float>"
    s = spark.createDataFrame([(1, "", "", "", None), (2, "one two", "", "", None), (3, "x", "", "", [1.0] + [0.0] * 15)], cols)

    def embed(df, col):
        return vec.hashing_embedder(df, col, dim=16)

    got = {r.video_no: r.embedding for r in maintenance.reembed(s, embed, 16).collect()}
    assert all(abs(np.linalg.norm(v) - 1) < 1e-6 for v in got.values())
    assert got[3] == [1.0] + [0.0] * 15
    with pytest.raises(Exception, match="embedding width is not 8"):
        maintenance.reembed(s, embed, 8).collect()
    blank = spark.createDataFrame([("",)], "t string")
    assert set(vec.hashing_embedder(blank, "t", dim=4).first().embedding) == {0.0}


def test_stable_id_is_path_scoped(spark):
    df = spark.createDataFrame([("/a",), ("/b",)], "p string").select(stable_uuid(F.col("p")).alias("u"))
    assert {r.u for r in df.collect()} == {str(uuid.uuid5(uuid.NAMESPACE_URL, p)) for p in ("/a", "/b")}


# --- nothing is cut short -----------------------------------------------------------


def test_page_of_any_size(spark):
    videos = spark.range(1000).select(F.col("id").alias("video_no"), F.col("id").alias("created_s"))
    segments = spark.range(3000).select((F.col("id") % 1000).alias("video_no"))
    page = browse.list_page(videos, segments, 1, 1000).collect()
    assert len(page) == 1000 and {r.segment_count for r in page} == {3}


def test_search_refuses_limits_out_of_range(spark):
    with pytest.raises(ValueError, match="limit"):
        search.search(spark.range(1), "x", k=101)


def test_blocks_of_queries_and_labels(spark, monkeypatch):
    rng = random.Random(1)
    vec = lambda: [rng.random() for _ in range(4)]
    segs = spark.createDataFrame([(i, 0, "done", vec()) for i in range(40)], "video_no long, seg_index int, status string, embedding array<double>")
    queries = spark.createDataFrame([(i, vec()) for i in range(7)], "query_no long, vector array<double>")
    labels = spark.createDataFrame([(i, f"l{i}", vec()) for i in range(11)], "label_no int, label string, vector array<double>")
    whole = sorted(map(tuple, search.semantic_topk_batch(segs, queries, 3).collect()))
    scenes = sorted(map(tuple, frames.zero_shot_label(segs, labels).collect()))
    monkeypatch.setattr(search, "BATCH_QUERIES", 2)
    monkeypatch.setattr(frames, "LABEL_BLOCK", 3)
    assert len(whole) == 21 and sorted(map(tuple, search.semantic_topk_batch(segs, queries, 3).collect())) == whole
    assert sorted(map(tuple, frames.zero_shot_label(segs, labels).collect())) == scenes


def test_repeated_keys_and_truth_values(spark):
    raw = [(1, 0, False, '{"topic":"first","topic":"second","confidence":true}', None), (1, 1, True, '{"topic":"x","confidence":false}', None)]
    got = tags.tag_answers(spark.createDataFrame(raw, "video_no long, seg_index int, is_silent boolean, raw_1 string, raw_2 string"))
    found = got.orderBy("seg_index").collect()
    assert [(r.topic, r.confidence, r.confidence_defaulted) for r in found] == [("second", 1.0, False), ("x", 0.0, False)]


def test_arrivals_never_refer_to_themselves(spark):
    cols = "video_id string, source_path string, content_hash string, file_size_bytes long, created_s long"
    stored = spark.createDataFrame([("a", "/a", "h1", 1, 1, "done", False), ("q", "/q", "h2", 1, 2, "queued", False)], cols + ", status string, is_duplicate boolean")
    batch = spark.createDataFrame(
        [("x", "/x", "h1", 1, 20), ("a", "/a", "h1", 1, 30), ("y", "/y", "h2", 1, 5), ("q", "/q", "h2", 1, 40), ("m", "/m", "h3", 1, 9), ("n", "/n", "h3", 1, 8), ("e", "/e", None, 0, 1)], cols
    )
    got = {r.video_id: (r.status, r.is_duplicate, r.canonical_video_id) for r in catalog.register_arrivals(batch, stored).collect()}
    assert got == {
        "x": ("done", True, "a"), "y": ("done", True, "q"), "q": ("queued", False, None), "m": ("done", True, "n"),
        "n": ("queued", False, None), "e": ("queued", False, None),
    }


def test_large_files_are_hashed_in_pieces(spark, tmp, monkeypatch):
    monkeypatch.setattr(files, "WHOLE_BYTES", 10)
    for name, body in (("a.MP4", b"x" * 100), ("b.mkv", b"small"), ("c.txt", b"not a video")):
        with open(f"{tmp}/{name}", "wb") as f:
            f.write(body)
    found = files.identify(spark, files.discover_folder(spark, tmp), tmp)
    got = {os.path.basename(r.source_path): (r.content_hash, r.file_size_bytes) for r in found.collect()}
    assert got == {"a.MP4": (hashlib.sha256(b"x" * 100).hexdigest(), 100), "b.mkv": (hashlib.sha256(b"small").hexdigest(), 5)}
