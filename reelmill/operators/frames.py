"""Planning which frames to take, labelling them, and gating the costly models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelmill.functions.columns import round_even
from reelmill.functions.ordered import AUTO, Ordered, ordered_scan
from reelmill.schemas import CAPTION_FRAMES, OCR_FRAME_CHARS, REALWORLD_SCENES, SCENE_CUT_SCORE, TEXTY_SCENES

KEY = "video_no"
# Labels scored together.
LABEL_BLOCK = 256


def plan_frame_times(
    videos: DataFrame, cuts: DataFrame, per_30s: float = 1.0, heavy: DataFrame | None | str = AUTO
) -> DataFrame:
    """Timestamps to grab: even anchors plus scene cuts, thinned to ``max_frames`` per video.

    ``videos`` has ``duration_sec`` and ``max_frames``; ``cuts`` has ``time_sec`` and ``score``. A plan that ends up empty
    takes the first frame.
    """
    v = videos.select(KEY, "duration_sec", "max_frames")
    n = F.least(F.col("max_frames"), F.greatest(F.lit(4), F.floor(F.col("duration_sec") / 30 * per_30s) + 1)).cast("int")
    anchors = v.where("duration_sec > 0").select(
        KEY,
        "duration_sec",
        "max_frames",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), n), lambda i: round_even(F.col("duration_sec") * i / (n + 1), 2)
            )
        ).alias("time_sec"),
    )
    scene_cuts = (
        cuts.where(F.col("score") > SCENE_CUT_SCORE)
        .select(KEY, round_even(F.col("time_sec"), 2).alias("time_sec"))
        .join(v.where("duration_sec > 0"), KEY)
        .where((F.col("time_sec") >= 0) & (F.col("time_sec") <= F.col("duration_sec")))
        .select(*anchors.columns)
    )
    times = anchors.where(F.col("time_sec") <= F.col("duration_sec")).unionByName(scene_cuts).distinct()
    placed = ordered_scan(
        times,
        [KEY],
        [F.col("time_sec")],
        F.floor(F.col("time_sec") / 3600),
        [Ordered("rn", "row_number"), Ordered("n", "count_all")],
        heavy,
    )
    # the i-th kept frame sits at place floor(i * n / cap): solve for i around the place instead of building the list
    place = F.col("rn") - 1
    step = F.col("n") / F.col("max_frames")
    near = F.floor(place / step)
    kept = F.exists(
        F.array(near - 1, near, near + 1),
        lambda i: (i >= 0) & (i < F.col("max_frames")) & (F.floor(i * step) == place),
    )
    planned = placed.where((F.col("n") <= F.col("max_frames")) | kept).select(KEY, "time_sec")
    return v.select(KEY).join(planned, KEY, "left").select(KEY, F.coalesce("time_sec", F.lit(0.0)).alias("time_sec"))


def zero_shot_label(frames: DataFrame, labels: DataFrame, scale: float = 1.0) -> DataFrame:
    """Label each ``embedding`` by softmax over its similarity to the label vectors; the first label wins ties.

    ``labels`` (``label_no``, ``label``, ``vector``) is a vocabulary. Each Arrow batch is scored against ``LABEL_BLOCK`` labels at a
    time, carrying the best one and the sum of the softmax, so no frame-label pair becomes a row.
    """
    vocabulary = labels.orderBy("label_no").collect()
    names = np.array([r["label"] for r in vocabulary], dtype=object)
    matrix = np.array([r["vector"] for r in vocabulary], dtype=np.float64).T

    @F.pandas_udf("label string, confidence double")
    def score(vectors: pd.Series) -> pd.DataFrame:
        if vectors.empty or not len(names):
            return pd.DataFrame({"label": pd.Series([None] * len(vectors), dtype=object), "confidence": pd.Series([None] * len(vectors), dtype=float)})
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        top, best, total = np.full(len(x), -np.inf), np.zeros(len(x), np.int64), np.zeros(len(x))
        for low in range(0, len(names), LABEL_BLOCK):
            sims = x @ matrix[:, low : low + LABEL_BLOCK] * scale
            most = sims.max(axis=1)
            best = np.where(most > top, low + sims.argmax(axis=1), best)
            new = np.maximum(top, most)
            total = total * np.exp(top - new) + np.exp(sims - new[:, None]).sum(axis=1)
            top = new
        return pd.DataFrame({"label": names[best], "confidence": 1 / total})

    return (
        frames.withColumn("scored", score("embedding"))
        .drop("embedding")
        .select("*", F.col("scored.label").alias("scene"), round_even(F.col("scored.confidence"), 3).alias("scene_conf"))
        .drop("scored")
    )


def gate_frames(frames: DataFrame) -> DataFrame:
    """Which frames go to the object detector (real-world scenes) and to OCR (texty scenes, or all of a silent video)."""
    return frames.withColumns(
        {
            "run_detector": F.col("scene").isin(REALWORLD_SCENES),
            "run_ocr": F.col("is_silent") | F.col("scene").isin(TEXTY_SCENES),
        }
    )


def apply_gate(frames: DataFrame) -> DataFrame:
    """Signals of gated frames: no objects outside real-world scenes, no text outside the OCR gate."""
    return gate_frames(frames).withColumns(
        {
            "objects": F.when(F.col("run_detector"), F.sort_array(F.array_distinct("objects"))).otherwise(
                F.array().cast("array<string>")
            ),
            "ocr": F.when(F.col("run_ocr"), F.substring("ocr", 1, OCR_FRAME_CHARS)).otherwise(""),
        }
    )


def run_model_on(
    frames: DataFrame,
    gate: str,
    model: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: StructType | str,
    keys: list[str],
) -> DataFrame:
    """Run a caller-supplied batch model on the gated rows only and join its columns back by ``keys``.

    The filter is applied before the model because nothing can be pushed through it afterwards.
    """
    return frames.join(frames.where(gate).mapInPandas(model, schema), keys, "left")


def collect_detections(detections: DataFrame) -> DataFrame:
    """Detector output (one row per hit) as a sorted distinct list per frame."""
    return detections.groupBy(KEY, "frame_no").agg(F.sort_array(F.collect_set("class_name")).alias("objects"))


def caption_sample(frames: DataFrame, videos: DataFrame, budget: int = CAPTION_FRAMES) -> DataFrame:
    """Frames to caption in silent videos: every (n // budget)-th frame, at most ``budget``. ``frame_no`` counts from 0."""
    silent = videos.where("is_silent").select(KEY)
    sizes = frames.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).join(silent, KEY)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / budget))
    return (
        frames.join(sizes, KEY)
        .where((F.col("frame_no") % step == 0) & (F.col("frame_no") < step * budget))
        .select(*frames.columns)
    )


def scene_distribution(frames: DataFrame) -> DataFrame:
    return frames.groupBy(KEY, "scene").agg(F.count(F.lit(1)).alias("n"))


def scene_distribution_map(frames: DataFrame) -> DataFrame:
    """The distribution as one map per video (as many entries as there are labels)."""
    return scene_distribution(frames).groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("scene", "n"))).alias("scenes"))
