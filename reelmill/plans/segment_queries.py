"""Segmentation and signal attachment over the derived transcripts, frames and segments."""

from pyspark.sql import functions as F

from reelmill.functions.columns import round_even
from reelmill.operators import segmentation as op
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import SPAN_ROWS, segment_rules, with_views


@query("transcript_windows", with_views("SELECT * FROM windows", "windows"))
def transcript_windows(spark, sf_dir):
    return op.transcript_windows(lib.transcript(spark, sf_dir))


def _windows(spark, sf_dir):
    return lib.window_vectors(spark, sf_dir, op.transcript_windows(lib.transcript(spark, sf_dir)))


def _doc_lengths(spark, sf_dir):
    return lib.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_no"), (F.col("n_chars") / 16).alias("duration_sec")
    )


@query(
    "adjacent_drop",
    with_views("SELECT video_no, window_no, round_even(drop, 6)::DOUBLE AS drop FROM drops WHERE drop IS NOT NULL", "drops"),
)
def adjacent_drop(spark, sf_dir):
    out = op.adjacent_drop(_windows(spark, sf_dir)).where("drop IS NOT NULL")
    return out.select("video_no", "window_no", round_even(F.col("drop"), 6).alias("drop"))


@query(
    "knee_threshold",
    with_views("SELECT video_no, round_even(threshold, 6)::DOUBLE AS threshold FROM thresholds", "thresholds"),
)
def knee_threshold(spark, sf_dir):
    out = op.knee_threshold(op.adjacent_drop(_windows(spark, sf_dir)))
    return out.withColumn("threshold", round_even(F.col("threshold"), 6))


ALL_CUTS = """SELECT video_no, start_sec, end_sec FROM cuts UNION ALL
    SELECT v.doc_id, 0.0::DOUBLE, coalesce(nullif(v.n_chars/16.0::DOUBLE, 0), w.e, 0.0::DOUBLE) FROM documents v
    LEFT JOIN (SELECT video_no, count(*) AS n, max(end_sec) AS e FROM windows GROUP BY video_no) w ON w.video_no = v.doc_id
    WHERE coalesce(w.n, 0) <= 1"""


@query("cut_segments", with_views(ALL_CUTS, "cuts", "windows"))
def cut_segments(spark, sf_dir):
    drops = op.adjacent_drop(_windows(spark, sf_dir))
    return op.cut_segments(drops, op.knee_threshold(drops), _doc_lengths(spark, sf_dir))


@query("scene_runs", with_views("SELECT * FROM runs", "runs"))
def scene_runs(spark, sf_dir):
    return op.scene_runs(lib.frames(spark, sf_dir), lib.frame_videos(spark, sf_dir))


def _spans(spark, sf_dir):
    return lib.segments(spark, sf_dir).select("video_no", "start_sec", "end_sec")


@query(
    "merge_min_duration",
    with_views("SELECT video_no, a AS start_sec, b AS end_sec FROM merged", "segments", extra=segment_rules("segments", None)),
)
def merge_min_duration(spark, sf_dir):
    return op.merge_short(_spans(spark, sf_dir))


@query(
    "split_max_duration",
    with_views(
        "SELECT video_no, a AS start_sec, b AS end_sec FROM shaped",
        "segments",
        extra=segment_rules("segments", None, merge=False),
    ),
)
def split_max_duration(spark, sf_dir):
    return op.split_long(_spans(spark, sf_dir))


@query(
    "cap_segments",
    with_views(SPAN_ROWS, "segments", extra=segment_rules("segments", None, max_segments=3, merge=False, split=False)),
)
def cap_segments(spark, sf_dir):
    spans = op.shrink_to_fold(_spans(spark, sf_dir), max_segments=3)
    return op.cap_and_cover(spans, spans, max_segments=3, stretch=False)


@query(
    "cap_segments_in_slices",
    with_views(SPAN_ROWS, "segments", extra=segment_rules("segments", None, max_segments=2, merge=False, split=False)),
)
def cap_segments_in_slices(spark, sf_dir):
    """The cap with limits so low that many videos go through the rounds over slices."""
    spans = op.shrink_to_fold(_spans(spark, sf_dir), max_segments=2, fold_limit=8, slice_spans=10)
    return op.cap_and_cover(spans, spans, max_segments=2, stretch=False)


LENGTHS = "SELECT video_no, max(end_sec) + (video_no % 7)*40 AS duration_sec FROM segments GROUP BY video_no"


@query(
    "ensure_coverage",
    with_views(
        SPAN_ROWS,
        "segments",
        extra={"lengths": LENGTHS} | segment_rules("segments", "lengths", max_segments=None, merge=False, split=False),
    ),
)
def ensure_coverage(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    lengths = spans.groupBy("video_no").agg((F.max("end_sec") + (F.col("video_no") % 7) * 40).alias("duration_sec"))
    return op.cover(spans, lengths)


@query(
    "segment_voiced",
    with_views(
        SPAN_ROWS + " UNION ALL SELECT video_no, 0, start_sec, end_sec FROM all_cuts WHERE video_no NOT IN (SELECT video_no FROM cuts)",
        "cuts",
        "windows",
        extra={"all_cuts": ALL_CUTS, "lengths": "SELECT doc_id AS video_no, n_chars/16.0::DOUBLE AS duration_sec FROM documents"}
        | segment_rules("cuts", "lengths"),
    ),
)
def segment_voiced(spark, sf_dir):
    return op.segment_voiced(_windows(spark, sf_dir), _doc_lengths(spark, sf_dir))


@query("segment_silent", with_views(SPAN_ROWS, "runs", extra=segment_rules("runs", "frame_videos")))
def segment_silent(spark, sf_dir):
    return op.segment_silent(lib.frames(spark, sf_dir), lib.frame_videos(spark, sf_dir))


@query(
    "attach_transcript",
    with_views(
        """SELECT s.video_no, s.seg_index, s.start_sec, s.end_sec, coalesce(string_agg(t.text, ' ' ORDER BY t.line_no), '') AS text
           FROM transcript_segments s LEFT JOIN transcript t ON t.video_no = s.video_no AND t.start_sec >= s.start_sec
             AND t.start_sec < s.end_sec GROUP BY ALL""",
        "transcript",
        "transcript_segments",
    ),
)
def attach_transcript(spark, sf_dir):
    return op.attach_transcript(lib.transcript_segments(spark, sf_dir), lib.transcript(spark, sf_dir))


@query(
    "attach_frame_signals",
    with_views(
        """SELECT s.video_no, s.seg_index, coalesce(string_agg(DISTINCT f.scene, '|' ORDER BY f.scene), '') AS scenes,
             coalesce(string_agg(DISTINCT f.objects[1], '|' ORDER BY f.objects[1]), '') AS objects,
             coalesce(substr(string_agg(f.ocr, ' ' ORDER BY f.frame_no) FILTER (f.ocr <> ''), 1, 600), '') AS ocr,
             coalesce(array_to_string((list(f.caption ORDER BY f.frame_no) FILTER (f.caption <> ''))[1:4], '|'), '') AS captions
           FROM frame_segments s LEFT JOIN frames f ON f.video_no = s.video_no AND f.time_sec >= s.start_sec AND f.time_sec < s.end_sec
           GROUP BY ALL""",
        "frames",
        "frame_segments",
    ),
)
def attach_frame_signals(spark, sf_dir):
    out = op.attach_frame_signals(lib.frame_segments(spark, sf_dir), lib.frames(spark, sf_dir))
    return out.select(
        "video_no", "seg_index", "ocr", *[F.array_join(c, "|").alias(c) for c in ("scenes", "objects", "captions")]
    )
