"""Speech gate, transcript aggregates and the voice / silent route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelmill.functions.columns import ordered_join, round_even, words
from reelmill.schemas import MAX_FRAMES_SILENT, MAX_FRAMES_VOICE, MIN_SPEECH_SEC, NO_AUDIO_DB, SILENCE_DB

KEY = "video_no"


def mean_level_db(videos: DataFrame, levels: DataFrame) -> DataFrame:
    """Mean level over finite samples (one decimal) and the speech flag, taken from the unrounded mean."""
    finite = F.when(F.abs("level_db") < float("inf"), F.col("level_db"))
    means = levels.groupBy(KEY).agg(F.avg(finite).alias("mean_db"))
    mean = F.coalesce("mean_db", F.lit(NO_AUDIO_DB))
    return (
        videos.select(KEY)
        .join(means, KEY, "left")
        .select(KEY, round_even(mean, 1).alias("mean_level_db"), (mean > SILENCE_DB).alias("has_speech"))
    )


def transcript_agg(lines: DataFrame) -> DataFrame:
    """Full text in line order and the seconds of speech."""
    return lines.groupBy(KEY).agg(
        F.trim(ordered_join(F.collect_list(F.struct("line_no", "text")), "text")).alias("full_text"),
        round_even(F.sum(F.col("end_sec") - F.col("start_sec")), 1).alias("speech_sec"),
    )


def speech_features(videos: DataFrame, lines: DataFrame) -> DataFrame:
    """Words per minute, silence ratio and mean energy.

    Word counts are summed per line, so no full text is ever built. ``lines`` has ``voiced`` and ``energy``.
    """
    sums = lines.groupBy(KEY).agg(
        F.sum(F.size(words(F.col("text")))).alias("n_words"),
        F.sum(F.when(F.col("voiced"), F.col("end_sec") - F.col("start_sec")).otherwise(0.0)).alias("voiced_sec"),
        F.avg("energy").alias("energy"),
    )
    minutes = F.greatest(F.col("duration_sec") / 60, F.lit(1e-6))
    return (
        videos.select(KEY, "duration_sec")
        .join(sums, KEY, "left")
        .select(
            KEY,
            round_even(F.coalesce("n_words", F.lit(0)) / minutes, 1).alias("words_per_minute"),
            round_even(1 - F.coalesce("voiced_sec", F.lit(0.0)) / F.greatest("duration_sec", F.lit(1e-6)), 3).alias("silence_ratio"),
            round_even(F.col("energy"), 4).alias("mean_energy"),
        )
    )


def route_videos(videos: DataFrame) -> DataFrame:
    """Route each item by ``has_speech``, ``mean_level_db`` and ``speech_sec``; exactly the minimum counts as voice."""
    silent = ~F.col("has_speech") | (F.col("speech_sec") < MIN_SPEECH_SEC)
    return videos.withColumns(
        {
            "path": F.when(silent, "silent").otherwise("voice"),
            "max_frames": F.when(silent, MAX_FRAMES_SILENT).otherwise(MAX_FRAMES_VOICE),
            "ocr_all_frames": silent,
            "force_captions": silent,
            "reason": F.when(
                silent,
                F.concat(
                    F.lit("no narration (rms="), F.col("mean_level_db").cast("string"),
                    F.lit("dB, speech="), F.col("speech_sec").cast("string"), F.lit("s)"),
                ),
            ).otherwise(F.concat(F.lit("narration present (speech="), F.col("speech_sec").cast("string"), F.lit("s)"))),
        }
    )
