"""Cutting videos into coherent segments and attaching their signals.

Voiced videos are cut where neighbouring transcript windows differ; silent ones where the scene label changes. Cuts then pass through
the same four rules: merge short, split long, cap the number, cover the whole duration. All steps but
the cap work on rows with :func:`ordered_scan`, so no step needs a whole video in one task; the cap shrinks very long
videos by rounds over slices of neighbours first and folds an array of at most ``FOLD_LIMIT`` spans at the end.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions.columns import dot, ordered_join, truthy
from reelmill.functions.intervals import match_in_time
from reelmill.functions.materialize import materialize
from reelmill.functions.ordered import AUTO, Ordered, ordered_scan, resolve_heavy
from reelmill.functions.span_merges import merge_shortest_first
from reelmill.functions.spans import cap_spans, ensure_coverage, split_span
from reelmill.schemas import (
    CAPTIONS_PER_SEGMENT,
    DROP_FALLBACK,
    DROP_FLOOR,
    MAX_SEGMENT_SEC,
    MAX_SEGMENTS,
    MIN_SEGMENT_SEC,
    OCR_SEGMENT_CHARS,
    WINDOW_SEC,
)

KEY = "video_no"
Heavy = DataFrame | None | str
# Spans of one video that may be folded as one array; must be at least 4 * max_segments.
FOLD_LIMIT = 2000
# Neighbouring spans of one video that meet in one task (1 MB of bounds).
SLICE_SPANS = 1 << 16
HOUR = 3600


def transcript_windows(lines: DataFrame, width: float = WINDOW_SEC) -> DataFrame:
    """Tumbling windows of transcript lines by start time; blank windows are dropped."""
    ends = lines.groupBy(KEY).agg(F.max_by("end_sec", "line_no").alias("last_end"))
    texts = (
        lines.select(KEY, F.floor(F.col("start_sec") / width).alias("window_no"), "line_no", "text")
        .groupBy(KEY, "window_no")
        .agg(ordered_join(F.collect_list(F.struct("line_no", "text")), "text").alias("text"))
        .where(F.col("text").rlike(r"\S"))
    )
    start = F.col("window_no") * width
    return (
        texts.join(ends, KEY)
        .where(start < F.col("last_end"))
        .select(
            KEY,
            "window_no",
            start.alias("start_sec"),
            F.least((F.col("window_no") + 1) * width, F.col("last_end")).alias("end_sec"),
            "text",
        )
    )


def adjacent_drop(windows: DataFrame, heavy: Heavy = AUTO) -> DataFrame:
    """``drop`` = 1 - similarity to the next window; NULL on the last window of a video."""
    scanned = ordered_scan(
        windows,
        [KEY],
        [F.col("window_no")],
        F.floor(F.col("window_no") / 120),
        [Ordered("next_embedding", "lead", F.col("embedding"))],
        heavy,
    )
    return scanned.withColumn(
        "drop", F.when(F.col("next_embedding").isNotNull(), 1.0 - dot(F.col("embedding"), F.col("next_embedding")))
    ).drop("embedding", "next_embedding")


def knee_threshold(drops: DataFrame, heavy: Heavy = AUTO) -> DataFrame:
    """Cut threshold per video: the knee of its sorted drops (published Kneedle rule, sensitivity 1).

    The drops form a convex increasing curve; flipped, it is walked from the largest drop down. A local maximum of the difference curve
    sets a threshold one mean step below itself, a local minimum resets it to zero, and the first later
    value under the threshold accepts the latest maximum as the knee.
    """
    heavy = resolve_heavy(heavy, drops, [KEY])
    by_size = [-F.col("drop"), F.col("window_no")]
    slices = F.floor(F.col("drop") * -4096)
    ranked = ordered_scan(
        drops.where(F.col("drop").isNotNull()).select(KEY, "window_no", "drop"),
        [KEY],
        by_size,
        slices,
        [
            Ordered("i", "row_number"),
            Ordered("n", "count_all"),
            Ordered("low", "min_all", F.col("drop")),
            Ordered("high", "max_all", F.col("drop")),
        ],
        heavy,
    )
    height = F.try_divide(F.col("high") - F.col("drop"), F.col("high") - F.col("low"))
    width = F.try_divide((F.col("i") - 1).cast("double"), (F.col("n") - 1).cast("double"))
    curve = ranked.withColumn("d", height - width)
    around = ordered_scan(
        curve, [KEY], by_size, slices, [Ordered("d_before", "lag", F.col("d")), Ordered("d_after", "lead", F.col("d"))], heavy
    )
    d, before, after = F.col("d"), F.col("d_before"), F.col("d_after")
    is_max = d.isNotNull() & (before.isNull() | (d >= before)) & (after.isNull() | (d >= after))
    is_min = d.isNotNull() & (before.isNull() | (d <= before)) & (after.isNull() | (d <= after))
    level = F.when(is_min, 0.0).when(is_max, d - F.try_divide(F.lit(1.0), (F.col("n") - 1).cast("double")))
    walked = ordered_scan(
        around,
        [KEY],
        by_size,
        slices,
        [Ordered("level", "last", level), Ordered("knee", "last", F.when(is_max, F.col("drop")))],
        heavy,
    )
    accepted = F.col("knee").isNotNull() & (after < F.col("level"))
    found = walked.groupBy(KEY).agg(F.min_by("knee", F.when(accepted, F.col("i"))).alias("knee"))
    # greatest() skips NULLs, so a missing knee has to be tested for
    threshold = F.when(F.col("knee").isNull(), DROP_FALLBACK).otherwise(F.greatest("knee", F.lit(DROP_FLOOR)))
    return found.select(KEY, threshold.alias("threshold"))


def cut_segments(drops: DataFrame, thresholds: DataFrame, videos: DataFrame, heavy: Heavy = AUTO) -> DataFrame:
    """Cut between windows whose drop reaches the threshold; a video of at most one window is one segment.

    ``drops`` is :func:`adjacent_drop`; ``videos`` has ``duration_sec``. Returns spans per video, unnumbered.
    """
    heavy = resolve_heavy(heavy, drops, [KEY])
    seen = ordered_scan(
        drops.select(KEY, "window_no", "start_sec", "end_sec", "drop"),
        [KEY],
        [F.col("window_no")],
        F.floor(F.col("window_no") / 120),
        [
            Ordered("rn", "row_number"),
            Ordered("n", "count_all"),
            Ordered("before", "lag", F.col("drop")),
            Ordered("prev_end", "lag", F.col("end_sec")),
            Ordered("last_end", "max_all", F.col("end_sec")),
        ],
        heavy,
    )
    opens = seen.join(thresholds, KEY, "left").where((F.col("rn") == 1) | (F.col("before") >= F.col("threshold")))
    ended = ordered_scan(
        opens.where("n > 1").select(KEY, "start_sec", "prev_end", "last_end"),
        [KEY],
        [F.col("start_sec")],
        F.floor(F.col("start_sec") / HOUR),
        [Ordered("next_prev_end", "lead", F.col("prev_end"))],
        heavy,
    )
    many = ended.select(KEY, "start_sec", F.coalesce("next_prev_end", "last_end").alias("end_sec"))
    counted = drops.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.max("end_sec").alias("window_end"))
    single = (
        videos.select(KEY, "duration_sec")
        .join(counted, KEY, "left")
        .where(F.coalesce(F.col("n"), F.lit(0)) <= 1)
        .select(
            KEY,
            F.lit(0.0).alias("start_sec"),
            F.coalesce(F.nullif(F.col("duration_sec"), F.lit(0.0)), F.col("window_end"), F.lit(0.0)).alias("end_sec"),
        )
    )
    return many.unionByName(single)


def scene_runs(frames: DataFrame, videos: DataFrame, heavy: Heavy = AUTO) -> DataFrame:
    """Runs of equal neighbouring scene labels (a missing label is a label); the first run starts at 0."""
    heavy = resolve_heavy(heavy, frames, [KEY])
    order = [F.col("time_sec"), F.col("frame_no")]
    hour = F.floor(F.col("time_sec") / HOUR)
    seen = ordered_scan(
        frames.select(KEY, "frame_no", "time_sec", "scene"),
        [KEY],
        order,
        hour,
        [Ordered("rn", "row_number"), Ordered("prev_scene", "lag", F.col("scene"))],
        heavy,
    )
    opens = seen.where((F.col("rn") == 1) | ~F.col("scene").eqNullSafe(F.col("prev_scene")))
    ended = ordered_scan(opens, [KEY], order, hour, [Ordered("next_time", "lead", F.col("time_sec"))], heavy)
    return videos.select(KEY, "duration_sec").join(ended, KEY, "left").select(
        KEY,
        F.when(F.coalesce(F.col("rn"), F.lit(1)) == 1, 0.0).otherwise(F.col("time_sec")).alias("start_sec"),
        F.coalesce("next_time", "duration_sec").alias("end_sec"),
        "scene",
    )


def merge_short(spans: DataFrame, min_sec: float = MIN_SEGMENT_SEC, heavy: Heavy = AUTO) -> DataFrame:
    """Merge into the previous span while this span or the merged one before it is shorter than ``min_sec``.

    As a rule without a running state: a span opens a new result when it is long itself and either an earlier long
    span exists (whatever absorbed that one is long enough) or all spans before it together are long enough.
    """
    heavy = resolve_heavy(heavy, spans, [KEY])
    order = [F.col("start_sec"), F.col("end_sec")]
    hour = F.floor(F.col("start_sec") / HOUR)
    is_long = (F.col("end_sec") - F.col("start_sec")) >= min_sec
    seen = ordered_scan(
        spans.select(KEY, "start_sec", "end_sec"),
        [KEY],
        order,
        hour,
        [
            Ordered("rn", "row_number"),
            Ordered("prev_end", "lag", F.col("end_sec")),
            Ordered("first_start", "min_all", F.col("start_sec")),
            Ordered("last_end", "max_all", F.col("end_sec")),
            Ordered("n_long", "sum", is_long.cast("int")),
        ],
        heavy,
    )
    opens = (F.col("rn") == 1) | (is_long & ((F.col("n_long") > 1) | (F.col("prev_end") - F.col("first_start") >= min_sec)))
    ended = ordered_scan(
        seen.where(opens), [KEY], order, hour, [Ordered("next_prev_end", "lead", F.col("prev_end"))], heavy
    )
    return ended.select(KEY, "start_sec", F.coalesce("next_prev_end", "last_end").alias("end_sec"))


def split_long(spans: DataFrame, max_sec: float | None = MAX_SEGMENT_SEC, min_sec: float = MIN_SEGMENT_SEC) -> DataFrame:
    """Split over-long spans into equal parts; row-local."""
    s = F.struct("start_sec", "end_sec")
    return spans.select(KEY, F.inline(split_span(s, max_sec, min_sec)))


def _level_round(spans: DataFrame, heavy: Heavy, slice_spans: int, shift: int, max_segments: int) -> DataFrame:
    """All merges that spans under twice the video's minimum begin, as far as slices of ``slice_spans`` neighbours show them.

    The one-at-a-time rule reaches each of these before it stops: what they merge into is no such span, so at least a quarter of all
    spans stays. Spans of no length stay of no length when they are merged; of those only as many as the rule takes begin merges.
    """
    length = F.col("end_sec") - F.col("start_sec")
    placed = ordered_scan(
        spans.select(KEY, "start_sec", "end_sec"),
        [KEY],
        [F.col("start_sec"), F.col("end_sec")],
        F.floor(F.col("start_sec") / HOUR),
        [
            Ordered("place", "row_number"),
            Ordered("n", "count_all", F.lit(1)),
            Ordered("shortest", "min_all", length),
            Ordered("empty", "sum", (length <= 0).cast("int")),
        ],
        heavy,
    )
    short = F.when(F.col("shortest") > 0, length < 2 * F.col("shortest"))
    short = short.otherwise((length <= 0) & (F.col("empty") <= F.col("n") - max_segments))
    dealt = placed.select(KEY, "start_sec", "end_sec", "place", "n", short.alias("short"), F.floor((F.col("place") + shift) / slice_spans).alias("slice"))

    def merged(table):
        table = table.sort_by("place")
        place = table.column("place")
        sides = place[0].as_py() > 1, place[-1].as_py() < table.column("n")[0].as_py()
        bounds = (table.column(c).to_numpy() for c in ("start_sec", "end_sec"))
        return _span_table(table, *merge_shortest_first(*bounds, table.column("short").to_numpy(), None, *sides))

    return dealt.groupBy(KEY, "slice").applyInArrow(merged, spans.schema)


def _cap_in_task(spans: DataFrame, max_segments: int) -> DataFrame:
    """The one-at-a-time rule for videos that fit one slice."""

    def capped(table):
        table = table.sort_by([("start_sec", "ascending"), ("end_sec", "ascending")])
        bounds = (table.column(c).to_numpy() for c in ("start_sec", "end_sec"))
        return _span_table(table, *merge_shortest_first(*bounds, most=table.num_rows - max_segments))

    return spans.groupBy(KEY).applyInArrow(capped, spans.schema)


def _span_table(table, start, end):
    return pa.table([table.column(KEY).slice(0, len(start)), pa.array(start), pa.array(end)], names=[KEY, "start_sec", "end_sec"])


def shrink_to_fold(
    spans: DataFrame,
    max_segments: int = MAX_SEGMENTS,
    fold_limit: int = FOLD_LIMIT,
    heavy: Heavy = AUTO,
    slice_spans: int = SLICE_SPANS,
) -> DataFrame:
    """Bring every video to at most ``fold_limit`` spans; videos within it stay untouched, longer ones are capped.

    A video of at most ``slice_spans`` is capped by one task. A longer one is cut into slices, and each round does all merges of a level of
    lengths that can be seen within a slice; the slices of the next round lie across the borders of the last. So a round takes
    away a share of the spans, or at least about one slice of them where each merge hangs on the one before.
    """
    if fold_limit < 4 * max_segments or slice_spans < 4 * max_segments:
        raise ValueError("fold_limit and slice_spans must be at least four times max_segments")
    spans = materialize(spans.select(KEY, "start_sec", "end_sec"))
    settled: list[DataFrame] = []
    last, turn = None, 0
    while True:
        counts = spans.groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
        most, rows = counts.agg(F.max("n"), F.sum("n")).first()
        if not most or most <= fold_limit:
            return functools.reduce(DataFrame.unionByName, settled, spans)
        small = counts.where(F.col("n") <= fold_limit).select(KEY)
        fits = counts.where((F.col("n") > fold_limit) & (F.col("n") <= slice_spans)).select(KEY)
        settled.append(spans.join(small, KEY, "left_semi"))
        settled.append(_cap_in_task(spans.join(fits, KEY, "left_semi"), max_segments))
        if most <= slice_spans:
            return functools.reduce(DataFrame.unionByName, settled)
        if turn > 1 and rows >= last:
            raise RuntimeError("two rounds of merges removed no span")
        last = rows if turn % 2 == 0 else last
        above = spans.join(counts.where(F.col("n") > slice_spans).select(KEY), KEY, "left_semi")
        shift = turn % 2 * (slice_spans // 2)
        spans = materialize(_level_round(above, resolve_heavy(heavy, above, [KEY]), slice_spans, shift, max_segments))
        turn += 1


def cover(
    spans: DataFrame,
    videos: DataFrame,
    max_sec: float = MAX_SEGMENT_SEC,
    min_sec: float = MIN_SEGMENT_SEC,
    heavy: Heavy = AUTO,
) -> DataFrame:
    """Stretch the last span of each video to its duration; numbered rows. Only last spans are looked at, none is collected."""
    ends = spans.groupBy(KEY).agg(F.max(F.struct("start_sec", "end_sec")).alias("last"))
    tails = ends.join(videos.select(KEY, "duration_sec"), KEY, "left").select(
        KEY, F.inline(ensure_coverage(F.array("last"), F.col("duration_sec"), max_sec, min_sec))
    )
    heads = spans.select(KEY, "start_sec", "end_sec").join(ends, KEY)
    heads = heads.where(F.struct("start_sec", "end_sec") < F.col("last")).drop("last")
    numbered = ordered_scan(
        heads.unionByName(tails),
        [KEY],
        [F.col("start_sec"), F.col("end_sec")],
        F.floor(F.col("start_sec") / HOUR),
        [Ordered("place", "row_number")],
        heavy,
    )
    return numbered.select(KEY, (F.col("place") - 1).cast("int").alias("seg_index"), "start_sec", "end_sec")


def cap_and_cover(
    spans: DataFrame,
    videos: DataFrame,
    max_segments: int = MAX_SEGMENTS,
    max_sec: float = MAX_SEGMENT_SEC,
    min_sec: float = MIN_SEGMENT_SEC,
    stretch: bool = True,
) -> DataFrame:
    """Cap the number of spans and stretch to the duration; numbered rows. Takes the output of :func:`shrink_to_fold`."""
    folded = spans.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("start_sec", "end_sec"))).alias("spans"))
    folded = folded.withColumn("spans", cap_spans(F.col("spans"), max_segments))
    if stretch:
        folded = folded.join(videos.select(KEY, "duration_sec"), KEY, "left").withColumn(
            "spans", ensure_coverage(F.col("spans"), F.col("duration_sec"), max_sec, min_sec)
        )
    return folded.select(KEY, F.posexplode("spans").alias("seg_index", "s")).select(KEY, "seg_index", "s.start_sec", "s.end_sec")


def finish_segments(
    cuts: DataFrame, videos: DataFrame, fold_limit: int = FOLD_LIMIT, heavy: Heavy = AUTO
) -> DataFrame:
    """Merge short, split long, cap, cover: in this order on both paths."""
    heavy = resolve_heavy(heavy, cuts, [KEY])
    shaped = split_long(merge_short(cuts, heavy=heavy))
    return cap_and_cover(shrink_to_fold(shaped, fold_limit=fold_limit, heavy=heavy), videos)


def _untouched(segs: DataFrame) -> DataFrame:
    return segs.withColumn("seg_index", F.lit(0)).select(KEY, "seg_index", "start_sec", "end_sec")


def segment_voiced(windows: DataFrame, videos: DataFrame, fold_limit: int = FOLD_LIMIT, heavy: Heavy = AUTO) -> DataFrame:
    """Semantic segmentation: ``windows`` with embeddings, ``videos`` with durations -> numbered segments.

    Videos of at most one window keep their single segment as it is.
    """
    heavy = resolve_heavy(heavy, windows, [KEY])
    drops = materialize(adjacent_drop(windows, heavy).drop("text"))
    cuts = cut_segments(drops, knee_threshold(drops, heavy), videos, heavy)
    many = drops.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(KEY)
    return finish_segments(cuts.join(many, KEY, "left_semi"), videos, fold_limit, heavy).unionByName(
        _untouched(cuts.join(many, KEY, "left_anti"))
    )


def segment_silent(frames: DataFrame, videos: DataFrame, fold_limit: int = FOLD_LIMIT, heavy: Heavy = AUTO) -> DataFrame:
    """Visual segmentation by scene runs. Videos without frames keep one whole segment."""
    heavy = resolve_heavy(heavy, frames, [KEY])
    with_frames = frames.select(KEY).distinct()
    cuts = scene_runs(frames, videos, heavy).drop("scene")
    return finish_segments(cuts.join(with_frames, KEY, "left_semi"), videos, fold_limit, heavy).unionByName(
        _untouched(cuts.join(with_frames, KEY, "left_anti"))
    )


def attach_transcript(segments: DataFrame, lines: DataFrame, heavy: Heavy = AUTO) -> DataFrame:
    """``text`` of each segment: its lines by start time, joined in line order; '' when there is none.

    Lines are gathered per time bucket first (no further shuffle after the join) and the buckets then per segment.
    ``heavy`` names overfull (video, bucket) pairs.
    """
    found = match_in_time(
        segments.select(KEY, "seg_index", "start_sec", "end_sec"),
        lines.select(KEY, "line_no", F.col("start_sec").alias("line_start"), "text"),
        "line_start",
        heavy=heavy,
    )
    per_bucket = found.groupBy(KEY, "seg_index", "bucket").agg(F.collect_list(F.struct("line_no", "text")).alias("items"))
    texts = per_bucket.groupBy(KEY, "seg_index").agg(ordered_join(F.flatten(F.collect_list("items")), "text").alias("text"))
    return segments.join(texts, [KEY, "seg_index"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def attach_frame_signals(segments: DataFrame, frames: DataFrame, heavy: Heavy = AUTO) -> DataFrame:
    """Scenes, objects, on-screen text and first captions of the frames inside each segment.

    Every part of a bucket passes on distinct labels, and no more text and captions than a segment can show.
    """
    found = match_in_time(
        segments.select(KEY, "seg_index", "start_sec", "end_sec"),
        frames.select(KEY, "frame_no", "time_sec", "scene", "objects", "ocr", "caption"),
        "time_sec",
        heavy=heavy,
    )

    def listed(col: str, most: int) -> Column:
        items = F.collect_list(F.when(truthy(F.col(col)).isNotNull(), F.struct("frame_no", F.col(col).alias("v"))))
        return F.slice(F.sort_array(items), 1, most)

    per_bucket = found.groupBy(KEY, "seg_index", "bucket").agg(
        F.collect_set(truthy(F.col("scene"))).alias("scenes"),
        F.array_distinct(F.flatten(F.collect_set("objects"))).alias("objects"),
        # each text takes at least one character and a blank, so later ones cannot show
        listed("ocr", OCR_SEGMENT_CHARS).alias("ocr"),
        listed("caption", CAPTIONS_PER_SEGMENT).alias("captions"),
    )

    def gathered(col: str) -> Column:
        return F.flatten(F.collect_list(col))

    per_segment = per_bucket.groupBy(KEY, "seg_index").agg(
        F.sort_array(F.array_distinct(gathered("scenes"))).alias("scenes"),
        F.sort_array(F.array_distinct(gathered("objects"))).alias("objects"),
        F.substring(ordered_join(gathered("ocr"), "v"), 1, OCR_SEGMENT_CHARS).alias("ocr"),
        F.transform(F.slice(F.sort_array(gathered("captions")), 1, CAPTIONS_PER_SEGMENT), lambda x: x["v"]).alias("captions"),
    )
    none = F.array().cast("array<string>")
    return segments.join(per_segment, [KEY, "seg_index"], "left").withColumns(
        {c: F.coalesce(F.col(c), none) for c in ("scenes", "objects", "captions")} | {"ocr": F.coalesce("ocr", F.lit(""))}
    )
