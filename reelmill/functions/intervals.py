"""Matching points in time to the segments that contain them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.ordered import AUTO, resolve_heavy

# Seconds of media per join bucket: the usual maximum length of a segment.
BUCKET_SEC = 120.0


def in_buckets(segments: DataFrame, width: float = BUCKET_SEC) -> DataFrame:
    """One copy of a segment per time bucket it touches (``start_sec <= t < end_sec``)."""
    first = F.floor(F.col("start_sec") / width)
    last = F.greatest(F.ceil(F.col("end_sec") / width) - 1, first)
    return segments.withColumn("bucket", F.explode(F.sequence(first, last)))


def match_in_time(
    segments: DataFrame,
    points: DataFrame,
    at: str,
    key: str = "video_no",
    how: str = "inner",
    width: float = BUCKET_SEC,
    heavy: DataFrame | None | str = AUTO,
) -> DataFrame:
    """Join every point to the segments of its video whose half-open span contains it.

    Video and time bucket are equality keys and the span is a residual test, so one long video is spread over as many
    tasks as it has buckets, and nothing degrades to a nested loop. A bucket that is itself heavy is salted: its points are dealt
    over parts and its few segments copied to each. ``bucket`` in the result is the bucket with its part, so grouping by it
    pre-aggregates where the join ran.
    """
    right = points.withColumn("bucket", F.floor(F.col(at) / width))
    left = in_buckets(segments, width)
    heavy = resolve_heavy(heavy, right, [key, "bucket"])
    if heavy is not None:
        salts = F.broadcast(heavy.select(key, "bucket", "_salts"))
        n = F.coalesce("_salts", F.lit(1).cast("long"))
        dealt = F.pmod(F.xxhash64(*points.columns), n)
        right = right.join(salts, [key, "bucket"], "left").withColumn("bucket", F.struct("bucket", dealt.alias("part")))
        copies = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        left = left.join(salts, [key, "bucket"], "left").withColumn("_part", copies)
        left = left.withColumn("bucket", F.struct("bucket", F.col("_part").alias("part"))).drop("_part", "_salts")
    left, right = left.alias("s"), right.alias("p")
    cond = (
        (F.col(f"s.{key}") == F.col(f"p.{key}"))
        & (F.col("s.bucket") == F.col("p.bucket"))
        & (F.col("s.start_sec") <= F.col(f"p.{at}"))
        & (F.col(f"p.{at}") < F.col("s.end_sec"))
    )
    extra = [c for c in points.columns if c != key]
    return left.join(right, cond, how).select("s.*", *[F.col(f"p.{c}") for c in extra])
