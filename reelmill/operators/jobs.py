"""Job progress as a fold over an append-only event table.

Events: ``job_no``, ``video_no``, ``event_id``, ``us`` (microseconds), ``stage`` (``enqueue`` makes the job wait, ``start`` opens an attempt; ``done`` and
``failed`` end it; anything else is progress), ``seconds``, ``error_chain``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.columns import round_even
from reelmill.functions.ordered import AUTO, Ordered, ordered_scan, resolve_heavy
from reelmill.schemas import ERROR_CHARS, HEARTBEAT_MAX_AGE_SEC, MAX_RETRIES, RECENT_JOBS, STAGES, TRANSIENT_ERRORS

JOB = "job_no"
SOFT_TIME_LIMIT = "SoftTimeLimitExceeded"


def _state(stage: Column) -> Column:
    return F.when(stage.isin("done", "failed"), stage).when(stage == "enqueue", "queued").otherwise("processing")


def job_fold() -> list[Column]:
    """Aggregates of one job's events; each keeps one value per job, so partial results combine before the shuffle."""
    stage, at = F.col("stage"), F.struct("us", "event_id")
    failed, done, waits = stage == "failed", stage == "done", stage == "enqueue"
    error = F.substring(F.array_join("error_chain", " <- "), 1, ERROR_CHARS)
    return [
        F.max_by(_state(stage), at).alias("state"),
        F.max_by("stage", F.when(~failed & ~waits, at)).alias("current_stage"),
        F.count_if(stage == "start").alias("attempts"),
        F.max_by("seconds", F.when(~failed & ~done & ~waits, at)).alias("last_stage_seconds"),
        F.max(F.when(stage == "start", F.col("us"))).alias("started_us"),
        F.max(F.when(failed | done, F.col("us"))).alias("finished_us"),
        F.max_by(F.when(failed, error), F.when(failed | done, at)).alias("error"),
        F.max("us").alias("updated_us"),
    ]


def job_state(events: DataFrame) -> DataFrame:
    """Latest state of every job. A failure keeps the stage it happened in; success clears the error."""
    return events.groupBy(JOB).agg(*job_fold())


def latest_job(events: DataFrame) -> DataFrame:
    """Per video the job that was enqueued last."""
    jobs = events.groupBy("video_no", JOB).agg(F.min("us").alias("enqueued_us"))
    return jobs.groupBy("video_no").agg(
        F.max_by(JOB, F.struct("enqueued_us", JOB)).alias(JOB), F.max("enqueued_us").alias("enqueued_us")
    )


def job_elapsed(state: DataFrame, now_us: int) -> DataFrame:
    """Seconds from start to finish (or to now), one decimal; NULL for a job that never started."""
    spent = (F.coalesce("finished_us", F.lit(now_us)) - F.col("started_us")) / 1_000_000
    return state.select(JOB, round_even(spent, 1).alias("elapsed_sec"))


def state_transitions(events: DataFrame, heavy: DataFrame | None | str = AUTO) -> DataFrame:
    """Events at which (state, stage) differs from the event before."""
    heavy = resolve_heavy(heavy, events, [JOB])
    order = [F.col("us"), F.col("event_id")]
    hour = F.floor(F.col("us") / 3_600_000_000)
    staged = ordered_scan(
        events.select(JOB, "event_id", "us", "stage"),
        [JOB],
        order,
        hour,
        [Ordered("current_stage", "last", F.when(~F.col("stage").isin("failed", "enqueue"), F.col("stage")))],
        heavy,
    ).withColumn("state", _state(F.col("stage")))
    now = F.struct("state", "current_stage")
    compared = ordered_scan(staged, [JOB], order, hour, [Ordered("before", "lag", now)], heavy)
    return compared.where(~F.col("before").eqNullSafe(now)).select(JOB, "event_id", "us", "state", "current_stage")


def error_class(chain: Column) -> Column:
    """``transient`` when any exception name in the chain contains a known marker, else ``poison``."""
    known = "|".join(TRANSIENT_ERRORS)
    return F.when(F.exists(chain, lambda n: n.rlike(known)), "transient").otherwise("poison")


def retry_schedule(failures: DataFrame) -> DataFrame:
    """Seconds until the next attempt; NULL when the job is not tried again."""
    n = F.col("retries")
    soft = F.exists("error_chain", lambda e: e == SOFT_TIME_LIMIT)
    delay = F.when(soft, 30).when(
        F.col("error_class") == "transient", F.least(F.lit(600), (10 * F.pow(F.lit(2), n)).cast("int"))
    )
    return failures.withColumn("error_class", error_class(F.col("error_chain"))).withColumn(
        "retry_in_sec", F.when(n < MAX_RETRIES, delay)
    )


def worker_liveness(beats: DataFrame, now_us: int, max_age_sec: int = HEARTBEAT_MAX_AGE_SEC) -> DataFrame:
    """Age of each worker's latest heartbeat, and whether it still counts as alive."""
    age = (F.lit(now_us) - F.max("us")) / 1_000_000
    return beats.groupBy("worker").agg(age.alias("age")).select(
        "worker", round_even(F.col("age"), 1).alias("age_sec"), (F.col("age") <= max_age_sec).alias("alive")
    )


def readiness(checks: DataFrame, flag: str = "alive") -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and(flag), F.lit(False)).alias("ready"), F.count_if(flag).alias("passing"))


def stage_timings(events: DataFrame) -> DataFrame:
    """Count, total, mean and share of time per stage."""
    per = events.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("spent"))
    total = F.sum("spent").over(Window.partitionBy(F.lit(0)))  # over one row per stage
    return per.select(
        "stage",
        "n",
        round_even(F.col("spent"), 2).alias("total_sec"),
        round_even(F.col("spent") / F.col("n"), 4).alias("mean_sec"),
        round_even(F.col("spent") / total, 6).alias("share"),
    )


# Neighbouring slots of a timing sketch differ by this factor, so a percentile is off by 1 % at most.
SLOT_FACTOR = 1.02
SECONDS_PER_DAY = 86_400


def timing_sketch(events: DataFrame) -> DataFrame:
    """Counts per ``stage``, ``day`` and ``slot`` of the logarithm of the seconds; what takes no time is in the slot NULL.

    Sketches of other days or parts are merged by adding their counts. A sketch has at most some 1500 slots per stage and day between a
    microsecond and a year, however many events there are.
    """
    day = F.floor(F.col("us") / (SECONDS_PER_DAY * 1_000_000)).alias("day")
    slot = F.when(F.col("seconds") > 0, F.ceil(F.log("seconds") / math.log(SLOT_FACTOR))).cast("int").alias("slot")
    return events.where(F.col("seconds").isNotNull()).groupBy("stage", day, slot).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """One sketch of all events of several."""
    every = functools.reduce(DataFrame.unionByName, sketches)
    return every.groupBy("stage", "day", "slot").agg(F.sum("n").alias("n"))


def sketch_percentiles(sketch: DataFrame, shares: Sequence[float] = (0.5, 0.95), keys: Sequence[str] = ("stage",)) -> DataFrame:
    """Per key the number of events and ``p50``, ``p95``, ...: within 1 % of the value of that rank."""
    slots = sketch.groupBy(*keys, "slot").agg(F.sum("n").alias("n"))
    along = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("slot"))  # over the slots of a key
    seen = slots.withColumn("upto", F.sum("n").over(along)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    value = F.coalesce(F.pow(F.lit(SLOT_FACTOR), F.col("slot")) * 2 / (1 + SLOT_FACTOR), F.lit(0.0))
    found = [
        F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.struct("upto", value.alias("v"))))["v"].alias(f"p{round(100 * q)}") for q in shares
    ]
    out = seen.groupBy(*keys).agg(F.max("total").alias("n"), *found)
    return out.select(*keys, "n", *[round_even(F.col(f"p{round(100 * q)}"), 4).alias(f"p{round(100 * q)}") for q in shares])


def stage_index(stage: Column) -> Column:
    """Position among the ordered stages: all of them when done or stored, 0 at the start, -1 when unknown."""
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage) - 1
    return (
        F.when(stage.isin("done", "store"), F.lit(len(STAGES)))
        .when(stage == "start", F.lit(0))
        .otherwise(F.coalesce(place, F.lit(-1)))
        .cast("int")
    )


def queue_depth(state: DataFrame) -> DataFrame:
    return state.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def recent_jobs(events: DataFrame, size: int = RECENT_JOBS) -> DataFrame:
    """Most recently seen distinct jobs, newest first."""
    seen = events.groupBy(JOB).agg(F.max("us").alias("seen_us"))
    return seen.orderBy(F.desc("seen_us"), JOB).limit(size)


def reuse_stage_output(
    items: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], key: str, run: int = 0, rounds: int = 1
) -> DataFrame:
    """Stage output of all ``items`` (unique on ``key``): what ``path`` holds already, and the rest computed and stored there.

    The items are dealt over ``rounds``, each stored before the next begins. A run that was stopped is taken up by the next one, which
    computes only what isn't stored. ``run`` numbers the runs: the result tells in ``reused`` what an earlier one computed.
    """
    spark = items.sparkSession
    schema = compute(items.limit(0)).withColumn("run", F.lit(run)).schema

    def stored() -> DataFrame:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)  # so that there is a table to read
        return spark.read.schema(schema).parquet(path)

    for r in range(rounds):
        mine = items.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == r)
        rest = mine.join(stored().select(key), key, "left_anti")
        compute(rest).withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    kept = stored().join(items.select(key), key, "left_semi")
    return kept.withColumn("reused", F.col("run") != run).drop("run")
