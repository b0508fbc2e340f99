"""Re-embedding of stored segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelmill.functions.columns import first_truthy, once
from reelmill.functions.vectors import require_width
from reelmill.operators.jobs import reuse_stage_output
from reelmill.schemas import UNTITLED


def stored_embed_text(summary: Column, transcript: Column, topic: Column) -> Column:
    """Text a stored segment is embedded by."""
    return first_truthy(summary, transcript, topic, F.lit(UNTITLED))


def ingest_embed_text(summary: Column, text: Column, ocr: Column, captions: Column) -> Column:
    """Text a fresh segment is embedded by: the fallback reaches the screen text and the first caption."""
    return first_truthy(summary, text, ocr, F.get(captions, F.lit(0)), F.lit(UNTITLED))


def reembed(
    segments: DataFrame, embedder: Callable[[DataFrame, str], DataFrame], dim: int, everything: bool = False
) -> DataFrame:
    """Replace missing (or all) vectors. ``embedder(df, text_col)`` adds ``embedding``; its width is checked.

    Rows that keep their vector pass through untouched; the model sees only rows to embed.
    """
    todo = segments if everything else segments.where(F.col("embedding").isNull())
    text = stored_embed_text(F.col("summary"), F.col("transcript_text"), F.col("topic"))
    fresh = embedder(todo.drop("embedding").withColumn("_text", text), "_text").drop("_text")
    fresh = once(fresh, "_made", F.col("embedding")).drop("embedding").withColumnRenamed("_made", "embedding")  # or it would run twice
    fresh = require_width(fresh, dim).select(*segments.columns)
    if everything:
        return fresh
    return segments.where(F.col("embedding").isNotNull()).unionByName(fresh)


def reembed_resumable(
    segments: DataFrame, embedder: Callable[[DataFrame, str], DataFrame], dim: int, path: str, run: int = 0, rounds: int = 16
) -> DataFrame:
    """As :func:`reembed` for missing vectors, stored under ``path`` in ``rounds``: a run that was stopped is taken up by the next one,
    and the model sees no stored segment again. ``segments`` has ``video_no`` and ``seg_index``."""
    name = F.concat_ws("/", "video_no", "seg_index").alias("segment")
    text = stored_embed_text(F.col("summary"), F.col("transcript_text"), F.col("topic"))
    todo = segments.where(F.col("embedding").isNull()).select(name, text.alias("_text"))

    def embed(rows: DataFrame) -> DataFrame:
        # generated once, or the width check would have the model run a second time
        made = once(embedder(rows, "_text"), "made", F.col("embedding")).select("segment", F.col("made").alias("embedding"))
        return require_width(made, dim).select("segment", F.col("embedding").cast(segments.schema["embedding"].dataType).alias("fresh"))

    made = reuse_stage_output(todo, path, embed, "segment", run, rounds).drop("reused")
    joined = segments.withColumn("segment", name).join(made, "segment", "left")
    return joined.withColumn("embedding", F.coalesce("embedding", "fresh")).select(*segments.columns)
