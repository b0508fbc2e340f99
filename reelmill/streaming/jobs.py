"""Job events as a stream: latest state, transitions, liveness, and counts over event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reelmill.operators.jobs import JOB, job_fold

TRANSITION = "job_no long, event_id long, us long, state string, current_stage string"
# How long the state of a finished job is kept after its last event.
FINISHED_KEPT_MS = 7 * 24 * 3600 * 1000
LIVENESS = "worker long, last_us long, alive boolean"


def stream_job_state(events: DataFrame) -> DataFrame:
    """The batch fold as a running aggregate; write in update mode. State: one row per job."""
    return events.groupBy(JOB).agg(*job_fold())


def stream_transitions(events: DataFrame, keep_ms: int = FINISHED_KEPT_MS) -> DataFrame:
    """Changes of (state, stage) per job, keeping the last pair of each job as state.

    Events of a job must not arrive out of order across micro-batches; inside one they are sorted. The state of a job that is done or
    has failed is dropped when nothing has been heard of it for ``keep_ms``; a later event then counts as its first.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["job_no", "event_id", "us", "state", "current_stage"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        seen, last_state, last_stage = state.get if state.exists else (False, None, None)
        rows = pd.concat(list(batches)).sort_values(["us", "event_id"])
        now = rows["stage"].map({"done": "done", "failed": "failed", "enqueue": "queued"}).fillna("processing")
        at = rows["stage"].where(~rows["stage"].isin(["failed", "enqueue"])).ffill().fillna(last_stage or "")
        before = pd.DataFrame({"state": now.shift(fill_value=last_state or ""), "stage": at.shift(fill_value=last_stage or "")})
        changed = (now != before["state"]) | (at != before["stage"])
        if not seen:
            changed.iloc[0] = True
        out = rows[changed].assign(job_no=key[0], state=now[changed], current_stage=at[changed].replace("", None))
        state.update((True, now.iloc[-1], at.iloc[-1] or None))
        if now.iloc[-1] in ("done", "failed"):
            state.setTimeoutDuration(keep_ms)
        yield out[columns]

    return events.groupBy(JOB).applyInPandasWithState(
        advance, TRANSITION, "seen boolean, state string, stage string", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def stream_liveness(beats: DataFrame, max_age_sec: int = 60, delay: str = "10 seconds") -> DataFrame:
    """Per worker: alive at each heartbeat, not alive once event time passes its last heartbeat by ``max_age_sec``.

    ``beats`` has ``worker``, ``us`` and the event-time column ``ts``.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame([(key[0], last, False)], columns=["worker", "last_us", "alive"])
            return
        last = state.get[0] if state.exists else 0
        for b in batches:
            last = max(last, int(b["us"].max()))
        state.update((last,))
        due = last // 1000 + max_age_sec * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], last, True)], columns=["worker", "last_us", "alive"])

    return beats.withWatermark("ts", delay).groupBy("worker").applyInPandasWithState(
        advance, LIVENESS, "last_us long", "append", GroupStateTimeout.EventTimeTimeout
    )


# --- extensions: event-time counts a user of the folds above usually wants next ---


def stream_tumbling(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events per stage and tumbling window of event time ``ts``."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "stage")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))
        .select(F.col("window.start").alias("window_start"), "stage", "n", "seconds")
    )


def stream_session(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions of each job: runs of events no further apart than ``gap``."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), JOB)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), JOB, "n")
    )
