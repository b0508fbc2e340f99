"""Listings, pages, details and the console's data queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.operators.rollup import nested_segments, video_rollup
from reelmill.schemas import BOARD_SIZE, PAGE_SIZE, PAGE_SIZE_MAX


def list_videos(
    videos: DataFrame,
    status: str | None = None,
    language: str | None = None,
    has_speech: bool | None = None,
    include_deleted: bool = False,
) -> DataFrame:
    """Filtered listing. Text filters match anywhere, in any case; ``%`` and ``_`` act as wildcards; NULLs fail."""
    out = videos
    if not include_deleted:
        out = out.where(F.col("status") != "soft_deleted")
    if status:
        out = out.where(F.col("status") == status)
    if language:
        out = out.where(F.col("language").ilike(f"%{language}%"))
    if has_speech is not None:
        out = out.where(F.col("has_speech") == has_speech)
    return out


def with_segment_like(
    videos: DataFrame, segments: DataFrame, subject: str | None = None, grade: str | None = None, key: str = "video_no"
) -> DataFrame:
    """Videos having one segment that matches both patterns."""
    hit = segments
    if subject:
        hit = hit.where(F.col("subject").ilike(f"%{subject}%"))
    if grade:
        hit = hit.where(F.col("grade_level").ilike(f"%{grade}%"))
    # distinct first: the semi join then sees one row per video however many segments match
    return videos.join(hit.select(key).distinct(), key, "left_semi")


def list_total(videos: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    total = F.count(F.lit(1))
    pages = F.ceil(total / size) if size > 0 else F.lit(0).cast("long")
    return videos.agg(total.alias("total"), pages.alias("pages"))


def list_page(videos: DataFrame, segments: DataFrame, page: int = 1, size: int = PAGE_SIZE, key: str = "video_no") -> DataFrame:
    """One page, newest first, each row with its segment count.

    The page is cut first; segments are then counted for those rows only. A page of at most ``PAGE_SIZE_MAX`` rows is
    broadcast for that, a larger one is joined like any other table.
    """
    size = max(1, size)
    return _with_counts(videos.orderBy(F.desc("created_s"), key).offset((max(page, 1) - 1) * size).limit(size), segments, size, key)


def _with_counts(rows: DataFrame, segments: DataFrame, size: int, key: str) -> DataFrame:
    counts = (
        segments.select(key)
        .join(F.broadcast(rows.select(key)) if size <= PAGE_SIZE_MAX else rows.select(key), key, "left_semi")
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("segment_count"))
    )
    return rows.join(counts, key, "left").withColumn("segment_count", F.coalesce("segment_count", F.lit(0).cast("long")))


# Ranges whose rows are counted to find a page, and rows of the ranges holding it that need no finer count.
PAGE_RANGES, PAGE_ROWS = 1024, 10_000


def list_page_by_ranges(
    videos: DataFrame, segments: DataFrame, page: int = 1, size: int = PAGE_SIZE, key: str = "video_no", enough: int = PAGE_ROWS
) -> DataFrame:
    """As :func:`list_page`, for pages however deep: rows are counted per range of ``created_s`` (a whole number), and only the ranges
    that hold the page are sorted. Ranges of over ``enough`` rows are counted again in finer steps, down to single seconds."""
    size = max(1, size)
    skip, within = (max(page, 1) - 1) * size, videos
    while True:
        low, high = within.agg(F.min("created_s"), F.max("created_s")).first()
        if low is None:
            break
        step = -(-(high - low + 1) // PAGE_RANGES)
        place = F.expr(f"(created_s - {low}L) div {step}L").alias("place")
        counts = {r["place"]: r["n"] for r in within.groupBy(place).agg(F.count(F.lit(1)).alias("n")).collect()}  # PAGE_RANGES and null
        places = [*sorted((p for p in counts if p is not None), reverse=True), *([None] if None in counts else [])]
        before, held = 0, []
        for p in places:
            if before + counts[p] > skip and before < skip + size:
                held.append(p)
            before += counts[p]
        if not held:
            return _with_counts(videos.limit(0), segments, size, key)
        skip -= sum(counts[p] for p in places[: places.index(held[0])])
        named = [p for p in held if p is not None]
        chosen = F.col("created_s").isNull() if None in held else F.lit(False)
        if named:
            chosen = chosen | F.col("created_s").between(low + named[-1] * step, low + named[0] * step + step - 1)
        within = within.where(chosen)
        if len(counts) == len(held) or step == 1 or sum(counts[p] for p in held) <= enough:
            break
    return _with_counts(within.orderBy(F.desc("created_s"), key).offset(skip).limit(size), segments, size, key)


def video_detail(videos: DataFrame, segments: DataFrame, key: str = "video_no") -> DataFrame:
    """Video, ordered segments and summary in one row."""
    fields: list[Column] = [F.col(c) for c in ("seg_index", *[c for c in segments.columns if c not in (key, "seg_index")])]
    return videos.join(video_rollup(segments, key, export_times=False), key, "left").join(
        nested_segments(segments, fields, key), key, "left"
    )


def distinct_subjects(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("subject").isNotNull()).select("subject").distinct().orderBy("subject")


def in_flight_board(videos: DataFrame, key: str = "video_no", size: int = BOARD_SIZE) -> DataFrame:
    """Up to ``size`` processing and ``size`` queued items, newest first; the rank filter limits before the shuffle."""
    newest = Window.partitionBy("status").orderBy(F.desc("created_s"), F.col(key))
    return (
        videos.where(F.col("status").isin("processing", "queued"))
        .select(key, "status", "created_s", F.row_number().over(newest).alias("place"))
        .where(F.col("place") <= size)
    )


def segment_timeline(segments: DataFrame, videos: DataFrame, key: str = "video_no") -> DataFrame:
    """Bar layout in percent of the video: duration, else the last segment end (at least 1)."""
    ends = segments.groupBy(key).agg(F.greatest(F.max("end_sec"), F.lit(1.0)).alias("last_end"))
    length = videos.select(key, "duration_sec")
    total = F.when(F.col("duration_sec") > 0, F.col("duration_sec")).otherwise(F.col("last_end"))
    scale = ends.join(length, key, "left").select(key, total.alias("total"))
    shown = F.greatest(F.lit(0.15), F.least(F.lit(1.0), F.col("confidence")))
    return segments.join(scale, key).select(
        key,
        "seg_index",
        (F.col("start_sec") / F.col("total") * 100).alias("left_pct"),
        F.greatest((F.col("end_sec") - F.col("start_sec")) / F.col("total") * 100, F.lit(1.2)).alias("width_pct"),
        F.when(F.col("confidence").isNull(), 0.5).otherwise(shown).alias("shown_confidence"),
    )


def confidence_bands(segments: DataFrame) -> DataFrame:
    c = F.col("confidence")
    band = F.when(c.isNull(), "missing").when(c >= 0.7, "high").when(c >= 0.45, "medium").otherwise("low")
    return segments.groupBy("subject", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
