"""Job-state and text queries."""

from pyspark.sql import functions as F

from reelmill.functions.columns import words
from reelmill.functions.materialize import new_table_path
from reelmill.operators import jobs as op
from reelmill.operators import text as tx
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import with_views
from reelmill.schemas import STOP_WORDS

# 2024-02-01 00:00:00 UTC
NOW_US = 1_706_745_600_000_000

STATE = {
    "state": """SELECT job_no, arg_max(CASE WHEN stage IN ('done','failed') THEN stage WHEN stage = 'enqueue' THEN 'queued' ELSE 'processing' END,
          (us, event_id)) AS state, arg_max(stage, (us, event_id)) FILTER (stage NOT IN ('failed','enqueue')) AS current_stage, count(*) FILTER (stage = 'start') AS attempts,
        arg_max(seconds, (us, event_id)) FILTER (stage NOT IN ('done','failed','enqueue')) AS last_stage_seconds,
        max(us) FILTER (stage = 'start') AS started_us, max(us) FILTER (stage IN ('done','failed')) AS finished_us,
        nullif(arg_max(coalesce(CASE WHEN stage = 'failed' THEN array_to_string(error_chain, ' <- ') END, ''), (us, event_id))
          FILTER (stage IN ('done','failed')), '') AS error, max(us) AS updated_us FROM job_events GROUP BY job_no"""
}


@query("job_state", with_views("SELECT * FROM state", "job_events", extra=STATE))
def job_state(spark, sf_dir):
    return op.job_state(lib.job_events(spark, sf_dir))


@query(
    "latest_job",
    with_views(
        """SELECT video_no, arg_max(job_no, (e, job_no)) AS job_no, max(e) AS enqueued_us FROM
           (SELECT video_no, job_no, min(us) AS e FROM job_events GROUP BY ALL) GROUP BY video_no""",
        "job_events",
    ),
)
def latest_job(spark, sf_dir):
    return op.latest_job(lib.job_events(spark, sf_dir))


@query(
    "job_elapsed",
    with_views(
        f"""SELECT job_no, round_even((coalesce(finished_us, {NOW_US}) - started_us)/1000000.0::DOUBLE, 1)::DOUBLE AS elapsed_sec FROM state""",
        "job_events",
        extra=STATE,
    ),
)
def job_elapsed(spark, sf_dir):
    return op.job_elapsed(op.job_state(lib.job_events(spark, sf_dir)), NOW_US)


TRANSITIONS = """SELECT job_no, event_id, us, state, current_stage FROM (
    SELECT *, lag(state) OVER w AS s0, lag(current_stage) OVER w AS c0, row_number() OVER w AS rn FROM (
      SELECT *, CASE WHEN stage IN ('done','failed') THEN stage WHEN stage = 'enqueue' THEN 'queued' ELSE 'processing' END AS state,
        last_value(CASE WHEN stage NOT IN ('failed','enqueue') THEN stage END IGNORE NULLS) OVER (PARTITION BY job_no ORDER BY us, event_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_stage FROM job_events)
    WINDOW w AS (PARTITION BY job_no ORDER BY us, event_id))
    WHERE rn = 1 OR state IS DISTINCT FROM s0 OR current_stage IS DISTINCT FROM c0"""


@query("state_transitions", with_views(TRANSITIONS, "job_events"))
def state_transitions(spark, sf_dir):
    return op.state_transitions(lib.job_events(spark, sf_dir))


ERR = """CASE WHEN len(list_filter(error_chain, lambda n: regexp_matches(n, 'OperationalError|DisconnectionError|InterfaceError|ConnectionError|ConnectionResetError|TimeoutError|gaierror|RedisError|BrokenPipeError|ReadTimeout|APIConnectionError'))) > 0
    THEN 'transient' ELSE 'poison' END"""


@query(
    "error_class",
    with_views(f"SELECT event_id, {ERR} AS error_class FROM job_events WHERE error_chain IS NOT NULL", "job_events"),
)
def error_class(spark, sf_dir):
    failed = lib.job_events(spark, sf_dir).where("error_chain IS NOT NULL")
    return failed.select("event_id", op.error_class(F.col("error_chain")).alias("error_class"))


@query(
    "retry_schedule",
    with_views(
        f"""SELECT event_id, retries, c AS error_class, CASE WHEN retries < 5 THEN CASE WHEN list_contains(error_chain, 'SoftTimeLimitExceeded') THEN 30
             WHEN c = 'transient' THEN least(600, 10*pow(2, retries))::INTEGER END END AS retry_in_sec
           FROM (SELECT *, {ERR} AS c FROM job_events WHERE error_chain IS NOT NULL)""",
        "job_events",
    ),
)
def retry_schedule(spark, sf_dir):
    failed = lib.job_events(spark, sf_dir).where("error_chain IS NOT NULL")
    return op.retry_schedule(failed).select("event_id", "retries", "error_class", "retry_in_sec")


def _last_us(spark, sf_dir):
    return lib.job_events(spark, sf_dir).agg(F.max("us")).first()[0]


LIVE = {
    "live": """SELECT job_no AS worker, ((SELECT max(us) FROM job_events) - max(us))/1000000.0::DOUBLE AS age
        FROM job_events GROUP BY job_no"""
}


@query(
    "worker_liveness",
    with_views(
        "SELECT worker, round_even(age, 1)::DOUBLE AS age_sec, age <= 21600 AS alive FROM live", "job_events", extra=LIVE
    ),
)
def worker_liveness(spark, sf_dir):
    beats = lib.job_events(spark, sf_dir).withColumnRenamed("job_no", "worker")
    return op.worker_liveness(beats, _last_us(spark, sf_dir), max_age_sec=21600)


@query(
    "readiness",
    with_views(
        "SELECT bool_and(age <= 21600) AS ready, count(*) FILTER (age <= 21600) AS passing FROM live", "job_events", extra=LIVE
    ),
)
def readiness(spark, sf_dir):
    return op.readiness(worker_liveness(spark, sf_dir))


@query(
    "stage_timings",
    with_views(
        """SELECT stage, n, round_even(spent, 2)::DOUBLE AS total_sec, round_even(spent/n, 4)::DOUBLE AS mean_sec,
             round_even(spent/sum(spent) OVER (), 6)::DOUBLE AS share
           FROM (SELECT stage, count(*) AS n, sum(seconds) AS spent FROM job_events GROUP BY stage)""",
        "job_events",
    ),
)
def stage_timings(spark, sf_dir):
    return op.stage_timings(lib.job_events(spark, sf_dir))


@query(
    "stage_percentiles",
    with_views(
        """SELECT stage, total AS n, round_even(min(v) FILTER (upto >= ceil(total*0.5::DOUBLE)), 4)::DOUBLE AS p50,
             round_even(min(v) FILTER (upto >= ceil(total*0.95::DOUBLE)), 4)::DOUBLE AS p95
           FROM (SELECT *, coalesce(pow(1.02::DOUBLE, slot)*2/2.02::DOUBLE, 0) AS v, sum(n) OVER (PARTITION BY stage)::BIGINT AS total,
               sum(n) OVER (PARTITION BY stage ORDER BY slot NULLS FIRST) AS upto
             FROM (SELECT stage, CASE WHEN seconds > 0 THEN ceil(ln(seconds)/ln(1.02::DOUBLE)) END AS slot, count(*) AS n
               FROM job_events WHERE seconds IS NOT NULL GROUP BY ALL))
           GROUP BY stage, total""",
        "job_events",
    ),
)
def stage_percentiles(spark, sf_dir):
    """Median and 95th percentile of each stage, from the merged sketches of even and odd jobs."""
    events = lib.job_events(spark, sf_dir)
    parts = [op.timing_sketch(events.where(F.col("job_no") % 2 == k)) for k in (0, 1)]
    return op.sketch_percentiles(op.merge_sketches(*parts))


@query(
    "stage_progress",
    with_views(
        """SELECT event_id, stage, CASE stage WHEN 'done' THEN 7 WHEN 'store' THEN 7 WHEN 'start' THEN 0 WHEN 'ingest_audio' THEN 0
             WHEN 'route' THEN 1 WHEN 'extract_frames' THEN 2 WHEN 'visual' THEN 3 WHEN 'segmentation' THEN 4 WHEN 'llm' THEN 5
             ELSE -1 END::INTEGER AS progress FROM job_events""",
        "job_events",
    ),
)
def stage_progress(spark, sf_dir):
    return lib.job_events(spark, sf_dir).select("event_id", "stage", op.stage_index(F.col("stage")).alias("progress"))


@query("queue_depth", with_views("SELECT state, count(*) AS n FROM state GROUP BY state", "job_events", extra=STATE))
def queue_depth(spark, sf_dir):
    return op.queue_depth(op.job_state(lib.job_events(spark, sf_dir)))


@query(
    "recent_jobs",
    with_views(
        "SELECT job_no, max(us) AS seen_us FROM job_events GROUP BY job_no ORDER BY seen_us DESC, job_no LIMIT 20", "job_events"
    ),
)
def recent_jobs(spark, sf_dir):
    return op.recent_jobs(lib.job_events(spark, sf_dir))


@query(
    "reuse_stage_output",
    """SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::INTEGER AS n_words, doc_id % 3 = 0 AS reused
       FROM documents""",
)
def reuse_stage_output(spark, sf_dir):
    docs = lib.table(spark, sf_dir, "documents").select("doc_id", "text")

    def count_words(df):
        return df.select("doc_id", F.size(words(F.col("text"))).alias("n_words"))

    path = new_table_path(spark, "stage-output")
    op.reuse_stage_output(docs.where("doc_id % 3 = 0"), path, count_words, "doc_id", run=1)
    return op.reuse_stage_output(docs, path, count_words, "doc_id", run=2, rounds=2)


@query(
    "keyword_share",
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS k FROM documents),
         p AS (SELECT doc_id, list_filter(k || list_transform(range(1, len(k)), lambda i: k[i]||' '||k[i+1]),
                 lambda x: length(x) BETWEEN 2 AND 40) AS l FROM t),
         c AS (SELECT doc_id, phrase, total, count(*) AS n FROM (SELECT doc_id, len(l) AS total, unnest(l) AS phrase FROM p) GROUP BY ALL)
       SELECT doc_id, phrase, round_even(n/total::DOUBLE, 3)::DOUBLE AS score, place::INTEGER AS place FROM (SELECT *, row_number() OVER
         (PARTITION BY doc_id ORDER BY n DESC, phrase) AS place FROM c) WHERE place <= 20""",
)
def keyword_share(spark, sf_dir):
    return tx.keyword_share(lib.texts(spark, sf_dir).select("doc_id", "text"))


@query(
    "keyphrases",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'),
             lambda x: x <> '' AND x NOT IN ({", ".join(repr(w) for w in STOP_WORDS)})) AS k FROM documents),
         p AS (SELECT doc_id, list_filter(k || list_transform(range(1, len(k)), lambda i: k[i]||' '||k[i+1]),
                 lambda x: length(x) BETWEEN 2 AND 40) AS l FROM t),
         c AS (SELECT doc_id, phrase, total, count(*) AS n FROM (SELECT doc_id, len(l) AS total, unnest(l) AS phrase FROM p) GROUP BY ALL),
         s AS (SELECT doc_id, phrase, round_even(n/total::DOUBLE * ln(((SELECT count(*) FROM documents) + 1)/(df + 1)::DOUBLE), 6)::DOUBLE AS score
               FROM c JOIN (SELECT phrase, count(*) AS df FROM c GROUP BY phrase) USING (phrase))
       SELECT doc_id, phrase, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER
         (PARTITION BY doc_id ORDER BY score DESC, phrase) AS place FROM s) WHERE place <= 20""",
)
def keyphrases(spark, sf_dir):
    return tx.keyphrases(lib.texts(spark, sf_dir).select("doc_id", "text"))


@query(
    "keyphrases_by_embedding",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS k FROM documents),
         slots AS (SELECT token, ((instr(d, h[1])-1)*4096 + (instr(d, h[2])-1)*256 + (instr(d, h[3])-1)*16 + instr(d, h[4])-1) % 64 AS slot
           FROM (SELECT token, md5(token) AS h, '0123456789abcdef' AS d FROM (SELECT DISTINCT unnest(k) AS token FROM t))),
         text_slots AS (SELECT doc_id, slot, count(*) AS n FROM (SELECT doc_id, unnest(k) AS token FROM t) JOIN slots USING (token) GROUP BY ALL),
         text_len AS (SELECT doc_id, sqrt(sum(n*n)::DOUBLE) AS l FROM text_slots GROUP BY doc_id),
         u AS (SELECT doc_id, list_filter(k, lambda x: length(x) > 1 AND x NOT IN ({", ".join(repr(w) for w in STOP_WORDS)})) AS k FROM t),
         p AS (SELECT DISTINCT doc_id, unnest(list_filter(k || list_transform(range(1, len(k)), lambda i: k[i]||' '||k[i+1]),
                 lambda x: length(x) BETWEEN 2 AND 40)) AS phrase FROM u),
         phrase_slots AS (SELECT phrase, slot, count(*) AS m FROM (SELECT phrase, unnest(string_split(phrase, ' ')) AS token
           FROM (SELECT DISTINCT phrase FROM p)) JOIN slots USING (token) GROUP BY ALL),
         phrase_len AS (SELECT phrase, sqrt(sum(m*m)::DOUBLE) AS l FROM phrase_slots GROUP BY phrase),
         s AS (SELECT doc_id, phrase, round_even((sum(n*m)/(any_value(a.l)*any_value(b.l)))::DOUBLE, 6)::DOUBLE AS score
               FROM p JOIN phrase_slots USING (phrase) JOIN text_slots USING (doc_id, slot) JOIN text_len a USING (doc_id)
                 JOIN phrase_len b USING (phrase) GROUP BY doc_id, phrase)
       SELECT doc_id, phrase, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER
         (PARTITION BY doc_id ORDER BY score DESC, phrase) AS place FROM s) WHERE place <= 20""",
)
def keyphrases_by_embedding(spark, sf_dir):
    return tx.keyphrases_by_embedding(lib.texts(spark, sf_dir).select("doc_id", "text"))


@query(
    "entity_rollup",
    """SELECT doc_id, mention, label, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY mention, label)
         AS place FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS mention, lang AS label FROM documents))
       WHERE place <= 40""",
)
def entity_rollup(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0))
    mentions = lib.texts(spark, sf_dir).select(
        "doc_id", F.explode(found).alias("mention"), F.col("lang").alias("label")
    )
    return tx.entity_rollup(mentions)
