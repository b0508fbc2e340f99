"""From tagged segments to per-video values, summaries and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions.columns import difficulty_rank, round_even, truthy
from reelmill.functions.intervals import match_in_time
from reelmill.schemas import DIFFICULTIES

def _if(name: str, value: Column) -> Column:
    return F.when(F.col("facet") == name, value)


# Position of a value: segment number and place inside the segment in one sortable number.
PLACES = 1 << 20


def _placed_values(segments: DataFrame, facets: Column, key: str) -> DataFrame:
    """Distinct (video, facet, value, span) with count and first position.

    Keys and buffers are plain values, so this is a hash aggregate that combines map-side: a video with very many
    segments reaches the shuffle only as its distinct values. ``span`` is set for facets that rank by length.
    """
    return (
        segments.select(key, "seg_index", F.inline(facets))
        .groupBy(key, "facet", "value", "span")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("seg_index").cast("long") * PLACES + F.col("pos")).alias("first"))
    )


def _placed(name: str, value: Column, pos: Column | None = None, span: Column | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("facet"),
        value.alias("value"),
        (F.lit(0) if pos is None else pos).cast("int").alias("pos"),
        (F.lit(None) if span is None else span).cast("double").alias("span"),
    )


def _if_truthy(name: str, col: str) -> Column:
    return F.when(truthy(F.col(col)).isNotNull(), _placed(name, F.col(col)))


def majority(name: str) -> Column:
    """Aggregate: most common value of a facet, first encountered on a tie."""
    return F.max_by("value", _if(name, F.struct(F.col("n"), -F.col("first"))))


def rollup_majority(segments: DataFrame, key: str = "video_no") -> DataFrame:
    nothing = F.lit(None).cast("string")
    facets = F.array_compact(
        F.array(_if_truthy("subject", "subject"), _if_truthy("grade", "grade_level"), _placed("segment", nothing))
    )
    return _placed_values(segments, facets, key).groupBy(key).agg(
        majority("subject").alias("subject"), majority("grade").alias("grade")
    )


def video_rollup(segments: DataFrame, key: str = "video_no", export_times: bool = True) -> DataFrame:
    """Video-level summary: majority subject and grade, hardest difficulty, topic of the longest segment, topics, tags.

    ``export_times`` measures segment length on one-decimal times as the document does; otherwise on raw times.
    """
    start, end = F.col("start_sec"), F.col("end_sec")
    if export_times:
        start, end = round_even(start, 1), round_even(end, 1)
    single = F.array_compact(
        F.array(
            _if_truthy("subject", "subject"),
            _if_truthy("grade", "grade_level"),
            _if_truthy("difficulty", "difficulty"),
            _if_truthy("topic", "topic"),
            _placed("longest", F.col("topic"), span=end - start),
        )
    )
    tags = F.filter(F.transform("tags", lambda t, i: _placed("tag", t, i)), lambda f: truthy(f["value"]).isNotNull())
    none = F.array().cast("array<struct<facet:string,value:string,pos:int,span:double>>")
    rows = _placed_values(segments, F.concat(single, F.coalesce(tags, none)), key)

    def in_order(name: str) -> Column:
        found = F.sort_array(F.collect_list(_if(name, F.struct("first", "value"))))
        return F.transform(found, lambda x: x["value"])

    hardness = F.struct(difficulty_rank(F.col("value"), DIFFICULTIES), -F.col("first"))
    return rows.groupBy(key).agg(
        F.sum(_if("longest", F.col("n"))).alias("segment_count"),
        majority("subject").alias("subject"),
        majority("grade").alias("grade"),
        F.max_by("value", _if("difficulty", hardness)).alias("difficulty"),
        F.max_by("value", _if("longest", F.struct("span", -F.col("first")))).alias("primary_topic"),
        in_order("topic").alias("topics"),
        in_order("tag").alias("all_tags"),
    )


def video_topics(segments: DataFrame, key: str = "video_no") -> DataFrame:
    return (
        segments.where(truthy(F.col("topic")).isNotNull())
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    )


def dominant_scene(segments: DataFrame, frames: DataFrame, key: str = "video_no") -> DataFrame:
    """Most common scene label inside each segment (first frame decides ties); voice items get NULL.

    ``segments`` carries ``is_silent`` and ``scenes`` (the fallback is its first entry).
    """
    silent = segments.where("is_silent").select(key, "seg_index", "start_sec", "end_sec")
    labelled = frames.where(truthy(F.col("scene")).isNotNull()).select(key, "frame_no", "time_sec", "scene")
    best = (
        match_in_time(silent, labelled, "time_sec", key)
        .groupBy(key, "seg_index", "scene")
        .agg(F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("first"))
        .groupBy(key, "seg_index")
        .agg(F.max_by("scene", F.struct("n", -F.col("first"))).alias("best"))
    )
    return segments.join(best, [key, "seg_index"], "left").select(
        key,
        "seg_index",
        F.when(F.col("is_silent"), F.coalesce("best", F.get("scenes", F.lit(0)))).alias("dominant_scene"),
    )


def nested_segments(
    segments: DataFrame, fields: list[Column], key: str = "video_no", part_segments: int | None = None
) -> DataFrame:
    """Segments of a video in order, nested in one row.

    With ``part_segments`` a longer video continues in further rows, numbered by ``part_no``.
    """
    nested, parts = segments.select(key, F.struct(*fields).alias("s")), []
    if part_segments:
        part = F.floor(F.col("seg_index") / part_segments).alias("part_no")
        nested, parts = segments.select(key, part, F.struct(*fields).alias("s")), ["part_no"]
    return nested.groupBy(key, *parts).agg(F.sort_array(F.collect_list("s")).alias("segments"))


# What a document says of where its item was processed, from the item's ``runtime``.
PROVENANCE = ["os", "python", "gpu", "profile", "package_version"]


def export_documents(
    videos: DataFrame, segments: DataFrame, timings: DataFrame, key: str = "video_no", part_segments: int | None = None
) -> DataFrame:
    """Result documents, one row per video: provenance, rounded lengths, ordered segments and the video summary.

    Of ``videos`` all columns are kept; ``video_id`` also gives the short ``id8``, ``duration_sec`` is rounded to two decimals (0 if it is
    missing), and a map ``runtime`` becomes the fields of ``PROVENANCE``. ``timings`` has (video, stage, seconds): they make the map
    ``stage_timings`` and, to one decimal, their sum. ``part_segments`` as in :func:`nested_segments`.
    """
    fields = [
        (F.col("seg_index") + 1).alias("segment"),
        round_even(F.col("start_sec"), 1).alias("start"),
        round_even(F.col("end_sec"), 1).alias("end"),
        F.col("topic"),
        F.col("subject"),
        F.col("grade_level").alias("grade"),
        F.col("difficulty"),
        F.col("tags"),
        F.col("confidence"),
    ]
    fields += [F.col(c) for c in ("content_type", "subtopics", "summary", "dominant_scene") if c in segments.columns]
    if "objects" in segments.columns:
        fields.append(
            F.when(F.col("is_silent"), F.col("objects")).otherwise(F.array().cast("array<string>")).alias("objects_detected")
        )
    nested = nested_segments(segments, fields, key, part_segments)
    summary = video_rollup(segments, key)
    per_stage = timings.groupBy(key, "stage").agg(F.sum("seconds").alias("seconds"))
    stage = F.struct("stage", round_even(F.col("seconds").cast("double"), 2).alias("seconds"))
    spent = per_stage.groupBy(key).agg(
        round_even(F.sum("seconds"), 1).alias("pipeline_time_sec"),
        F.map_from_entries(F.sort_array(F.collect_list(stage))).alias("stage_timings"),
    )
    docs = videos.join(summary, key, "left").join(spent, key, "left").join(nested, key, "left")
    docs = docs.withColumn("segment_count", F.coalesce("segment_count", F.lit(0).cast("long")))
    if "video_id" in videos.columns:
        docs = docs.withColumn("id8", F.substring("video_id", 1, 8))
    if "duration_sec" in videos.columns:
        docs = docs.withColumn("duration_sec", round_even(F.coalesce("duration_sec", F.lit(0.0)), 2))
    if "runtime" in videos.columns:
        docs = docs.select("*", *[F.col("runtime")[c].alias(c) for c in PROVENANCE]).drop("runtime")
    return docs.withColumn("part_no", F.coalesce("part_no", F.lit(0).cast("long"))) if part_segments else docs


def batch_summary(processed: DataFrame) -> DataFrame:
    """Counts of a run from a table with an ``outcome`` per item."""
    o = F.col("outcome")
    return processed.agg(
        F.count_if(o == "processed").alias("processed"),
        F.count_if(o == "duplicate").alias("duplicates"),
        F.count_if(o == "skipped").alias("skipped"),
        F.count_if(o == "failed").alias("failed"),
    )
