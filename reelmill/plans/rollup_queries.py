"""Summaries, documents and listings over the derived segments."""

from pyspark.sql import functions as F

from reelmill.functions.columns import round_even, stable_uuid
from reelmill.operators import browse, rollup
from reelmill.operators.segmentation import attach_frame_signals
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import with_views


def majority_sql(col: str, out: str) -> str:
    return f"""SELECT video_no, arg_max({col}, (n, -f)) AS {out} FROM (SELECT video_no, {col}, count(*) AS n, min(seg_index) AS f
      FROM segments WHERE {col} IS NOT NULL AND {col} <> '' GROUP BY video_no, {col}) GROUP BY video_no"""


@query(
    "rollup_majority",
    with_views(
        """SELECT v.video_no, s.subject, g.grade FROM (SELECT DISTINCT video_no FROM segments) v
           LEFT JOIN subj s USING (video_no) LEFT JOIN grad g USING (video_no)""",
        "segments",
        extra={"subj": majority_sql("subject", "subject"), "grad": majority_sql("grade_level", "grade")},
    ),
)
def rollup_majority(spark, sf_dir):
    return rollup.rollup_majority(lib.segments(spark, sf_dir))


ROLLUP_VIEWS = {
    "subj": majority_sql("subject", "subject"),
    "grad": majority_sql("grade_level", "grade"),
    "hard": """SELECT video_no, arg_max(difficulty, (CASE difficulty WHEN 'intermediate' THEN 1 WHEN 'advanced' THEN 2
        WHEN 'expert' THEN 3 ELSE 0 END, -seg_index)) AS difficulty FROM segments GROUP BY video_no""",
    "prim": """SELECT video_no, arg_max(topic, (round_even(end_sec,1)::DOUBLE - round_even(start_sec,1)::DOUBLE, -seg_index)) AS primary_topic,
        count(*) AS segment_count FROM segments GROUP BY video_no""",
    "tops": """SELECT video_no, string_agg(topic, '|' ORDER BY f) AS topics FROM (SELECT video_no, topic, min(seg_index) AS f
        FROM segments WHERE topic <> '' GROUP BY video_no, topic) GROUP BY video_no""",
    "tgs": """SELECT video_no, string_agg(tag, '|' ORDER BY f) AS all_tags FROM (SELECT video_no, tag, min(seg_index*1000 + i) AS f
        FROM (SELECT video_no, seg_index, tags[i] AS tag, i FROM segments, range(1, len(tags)+1) r(i)) WHERE tag <> ''
        GROUP BY video_no, tag) GROUP BY video_no""",
    "roll": """SELECT p.video_no, p.segment_count, s.subject, g.grade, h.difficulty, p.primary_topic, t.topics, x.all_tags
        FROM prim p LEFT JOIN subj s USING (video_no) LEFT JOIN grad g USING (video_no) LEFT JOIN hard h USING (video_no)
        LEFT JOIN tops t USING (video_no) LEFT JOIN tgs x USING (video_no)""",
}


def flat_lists(df):
    return df.withColumns({"topics": F.array_join("topics", "|"), "all_tags": F.array_join("all_tags", "|")})


@query(
    "video_rollup",
    with_views(
        """SELECT r.*, v.status, v.language, v.created_s FROM roll r JOIN segment_videos v USING (video_no)""",
        "segments",
        "segment_videos",
        extra=ROLLUP_VIEWS,
    ),
)
def video_rollup(spark, sf_dir):
    videos = lib.segment_videos(spark, sf_dir).select("video_no", "status", "language", "created_s")
    return flat_lists(rollup.video_rollup(lib.segments(spark, sf_dir))).join(videos, "video_no")


@query(
    "video_topics",
    with_views(
        """SELECT video_no, string_agg(topic, '|' ORDER BY topic) AS topics
           FROM (SELECT DISTINCT video_no, topic FROM segments WHERE topic <> '') GROUP BY video_no""",
        "segments",
    ),
)
def video_topics(spark, sf_dir):
    return rollup.video_topics(lib.segments(spark, sf_dir)).withColumn("topics", F.array_join("topics", "|"))


@query(
    "batch_summary",
    with_views(
        """SELECT count(*) FILTER (outcome='processed') AS processed, count(*) FILTER (outcome='duplicate') AS duplicates,
             count(*) FILTER (outcome='skipped') AS skipped, count(*) FILTER (outcome='failed') AS failed
           FROM (SELECT CASE WHEN status = 'failed' THEN 'failed' WHEN is_duplicate THEN 'duplicate'
                   WHEN status = 'done' THEN 'processed' ELSE 'skipped' END AS outcome FROM videos)""",
        "videos",
    ),
)
def batch_summary(spark, sf_dir):
    outcome = (
        F.when(F.col("status") == "failed", "failed")
        .when(F.col("is_duplicate"), "duplicate")
        .when(F.col("status") == "done", "processed")
        .otherwise("skipped")
    )
    return rollup.batch_summary(lib.videos(spark, sf_dir).select(outcome.alias("outcome")))


@query(
    "dominant_scene",
    with_views(
        """SELECT s.video_no, s.seg_index, CASE WHEN s.is_silent THEN d.scene END AS dominant_scene FROM frame_segments s
           LEFT JOIN (SELECT video_no, seg_index, arg_max(scene, (n, -f)) AS scene FROM (
             SELECT s.video_no, s.seg_index, f.scene, count(*) AS n, min(f.frame_no) AS f FROM frame_segments s JOIN frames f
             ON f.video_no = s.video_no AND f.time_sec >= s.start_sec AND f.time_sec < s.end_sec GROUP BY ALL)
             GROUP BY ALL) d USING (video_no, seg_index)""",
        "frames",
        "frame_segments",
    ),
)
def dominant_scene(spark, sf_dir):
    frames = lib.frames(spark, sf_dir)
    segs = attach_frame_signals(lib.frame_segments(spark, sf_dir), frames)
    return rollup.dominant_scene(segs, frames)


STAGE_TIMINGS = """SELECT l_orderkey AS video_no, round_even(sum(spent)::DOUBLE, 1)::DOUBLE AS pipeline_time_sec,
    string_agg(stage||'='||round_even(spent::DOUBLE, 2)::DECIMAL(18,2), ';' ORDER BY stage) AS stage_timings
    FROM (SELECT l_orderkey, l_returnflag AS stage, sum(l_quantity) AS spent FROM lineitem GROUP BY ALL) GROUP BY l_orderkey"""


@query(
    "export_documents",
    with_views(
        """SELECT v.video_no, v.status, v.language, left(h[1:8]||'-'||h[9:12], 8) AS id8, round_even(coalesce(total/7, 0)::DOUBLE, 2)::DOUBLE AS duration_sec,
             CASE WHEN v.video_no % 3 <> 0 THEN 'voice' ELSE 'silent' END AS tagging_path, 'linux '||v.video_no % 5 AS os, NULL::VARCHAR AS python,
             CASE WHEN v.video_no % 2 = 0 THEN 'a100' END AS gpu, v.language AS profile, '1.'||v.video_no % 3 AS package_version,
             coalesce(r.segment_count, 0) AS segment_count, r.subject, r.grade, r.difficulty,
             r.primary_topic, r.topics, r.all_tags, t.pipeline_time_sec, t.stage_timings, d.segments
           FROM segment_videos v JOIN (SELECT o_orderkey AS video_no, o_totalprice AS total,
               sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(o_orderkey||'.mp4')) AS h FROM orders) USING (video_no)
             LEFT JOIN roll r USING (video_no) LEFT JOIN tim t USING (video_no) LEFT JOIN docs d USING (video_no)""",
        "segments",
        "segment_videos",
        extra=ROLLUP_VIEWS
        | {
            "tim": STAGE_TIMINGS,
            "docs": """SELECT video_no, string_agg((seg_index+1)||':'||start_sec::BIGINT||'-'||end_sec::BIGINT||' '||topic,
                ';' ORDER BY seg_index) AS segments FROM segments GROUP BY ALL""",
        },
    ),
)
def export_documents(spark, sf_dir):
    """The documents with lists and maps as text."""
    n = F.col("video_no")
    prices = lib.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("video_no"), (F.col("o_totalprice") / 7).cast("double").alias("duration_sec"))
    runtime = F.create_map(
        F.lit("os"), F.concat(F.lit("linux "), n % 5), F.lit("gpu"), F.when(n % 2 == 0, "a100"), F.lit("profile"), F.col("language"),
        F.lit("package_version"), F.concat(F.lit("1."), n % 3),
    )
    videos = lib.segment_videos(spark, sf_dir).join(prices, "video_no").select(
        "video_no", "status", "language", stable_uuid(F.concat(n, F.lit(".mp4"))).alias("video_id"), "duration_sec",
        F.when(n % 3 != 0, "voice").otherwise("silent").alias("tagging_path"), runtime.alias("runtime"),
    )
    timings = lib.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("video_no"), F.col("l_returnflag").alias("stage"), F.col("l_quantity").alias("seconds")
    )
    docs = flat_lists(rollup.export_documents(videos, lib.segments(spark, sf_dir), timings)).drop("video_id")
    shown = F.transform(
        "segments",
        lambda s: F.concat(
            s["segment"].cast("string"), F.lit(":"), s["start"].cast("long").cast("string"), F.lit("-"),
            s["end"].cast("long").cast("string"), F.lit(" "), s["topic"],
        ),
    )
    spent = F.transform(F.map_entries("stage_timings"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("decimal(18,2)")))
    return docs.withColumn("segments", F.array_join(shown, ";")).withColumn("stage_timings", F.array_join(spent, ";"))


@query(
    "video_detail",
    with_views(
        """SELECT v.video_no, v.status, r.segment_count, r.subject, r.grade, r.difficulty, p.primary_topic, r.topics, r.all_tags, d.segments
           FROM segment_videos v LEFT JOIN roll r USING (video_no) LEFT JOIN raw_prim p USING (video_no) LEFT JOIN docs d USING (video_no)""",
        "segments",
        "segment_videos",
        extra=ROLLUP_VIEWS
        | {
            "raw_prim": "SELECT video_no, arg_max(topic, (end_sec - start_sec, -seg_index)) AS primary_topic FROM segments GROUP BY 1",
            "docs": """SELECT video_no, string_agg(seg_index||':'||topic||'/'||difficulty,
                ';' ORDER BY seg_index) AS segments FROM segments GROUP BY ALL""",
        },
    ),
)
def video_detail(spark, sf_dir):
    videos = lib.segment_videos(spark, sf_dir).select("video_no", "status")
    out = flat_lists(browse.video_detail(videos, lib.segments(spark, sf_dir)))
    shown = F.transform(
        "segments", lambda s: F.concat(s["seg_index"].cast("string"), F.lit(":"), s["topic"], F.lit("/"), s["difficulty"])
    )
    return out.withColumn("segments", F.array_join(shown, ";"))


@query(
    "list_videos_filtered",
    with_views(
        """SELECT video_no, status, language, has_speech FROM segment_videos WHERE status <> 'soft_deleted' AND status = 'done'
           AND language ILIKE '%m_d%' AND has_speech""",
        "segment_videos",
    ),
)
def list_videos_filtered(spark, sf_dir):
    v = lib.segment_videos(spark, sf_dir).select("video_no", "status", "language", "has_speech")
    return browse.list_videos(v, status="done", language="m_d", has_speech=True)


@query(
    "list_failures",
    with_views("SELECT video_no, status, owner_no FROM segment_videos WHERE status = 'failed'", "segment_videos"),
)
def list_failures(spark, sf_dir):
    v = lib.segment_videos(spark, sf_dir).select("video_no", "status", "owner_no")
    return browse.list_videos(v, status="failed")


@query(
    "list_videos_by_subject",
    with_views(
        """SELECT video_no, status FROM segment_videos WHERE status <> 'soft_deleted' AND video_no IN
           (SELECT video_no FROM segments WHERE subject ILIKE '%prom%' AND grade_level ILIKE '%brand#1%')""",
        "segments",
        "segment_videos",
    ),
)
def list_videos_by_subject(spark, sf_dir):
    v = browse.list_videos(lib.segment_videos(spark, sf_dir).select("video_no", "status"))
    return browse.with_segment_like(v, lib.segments(spark, sf_dir), subject="prom", grade="brand#1")


@query(
    "list_total",
    with_views(
        "SELECT count(*) AS total, ceil(count(*)/25.0)::BIGINT AS pages FROM segment_videos WHERE status <> 'soft_deleted'",
        "segment_videos",
    ),
)
def list_total(spark, sf_dir):
    return browse.list_total(browse.list_videos(lib.segment_videos(spark, sf_dir)))


@query(
    "list_page",
    with_views(
        """SELECT p.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = p.video_no) AS segment_count
           FROM (SELECT video_no, status, created_s FROM segment_videos WHERE status <> 'soft_deleted'
                 ORDER BY created_s DESC, video_no LIMIT 25 OFFSET 25) p""",
        "segment_videos",
    ),
)
def list_page(spark, sf_dir):
    v = browse.list_videos(lib.segment_videos(spark, sf_dir).select("video_no", "status", "created_s"))
    segs = lib.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_no"))
    return browse.list_page(v, segs, page=2)


@query(
    "list_page_deep",
    with_views(
        """SELECT video_no, status, created_s, (SELECT count(*) FROM lineitem WHERE l_orderkey = p.video_no) AS segment_count
           FROM (SELECT *, row_number() OVER (ORDER BY created_s DESC, video_no) AS place, count(*) OVER () AS n FROM
             (SELECT video_no, status, created_s FROM segment_videos WHERE status <> 'soft_deleted')) p
           WHERE (place - 1)//25 = n//50""",
        "segment_videos",
    ),
)
def list_page_deep(spark, sf_dir):
    """The page in the middle of the list."""
    v = browse.list_videos(lib.segment_videos(spark, sf_dir).select("video_no", "status", "created_s"))
    segs = lib.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("video_no"))
    return browse.list_page_by_ranges(v, segs, page=v.count() // 50 + 1)


@query(
    "distinct_subjects",
    with_views("SELECT DISTINCT subject FROM segments WHERE subject IS NOT NULL ORDER BY subject", "segments"),
)
def distinct_subjects(spark, sf_dir):
    return browse.distinct_subjects(lib.segments(spark, sf_dir))


@query(
    "in_flight_board",
    with_views(
        """SELECT video_no, status, created_s, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY status
             ORDER BY created_s DESC, video_no) AS place FROM segment_videos WHERE status IN ('processing','queued')) WHERE place <= 12""",
        "segment_videos",
    ),
)
def in_flight_board(spark, sf_dir):
    return browse.in_flight_board(lib.segment_videos(spark, sf_dir))


@query(
    "segment_timeline",
    with_views(
        """SELECT video_no, seg_index, round_even(start_sec/total*100, 6)::DOUBLE AS left_pct,
             round_even(greatest((end_sec-start_sec)/total*100, 1.2::DOUBLE), 6)::DOUBLE AS width_pct,
             CASE WHEN confidence IS NULL THEN 0.5::DOUBLE ELSE greatest(0.15::DOUBLE, least(1.0::DOUBLE, confidence)) END AS shown_confidence
           FROM (SELECT *, CASE WHEN video_no % 2 = 0 THEN 512.0::DOUBLE ELSE greatest(max(end_sec) OVER (PARTITION BY video_no), 1.0::DOUBLE) END
                 AS total FROM segments)""",
        "segments",
    ),
)
def segment_timeline(spark, sf_dir):
    length = F.when(F.col("video_no") % 2 == 0, 512.0).otherwise(0.0)
    v = lib.segment_videos(spark, sf_dir).select("video_no", length.alias("duration_sec"))
    out = browse.segment_timeline(lib.segments(spark, sf_dir), v)
    return out.withColumns({c: round_even(F.col(c), 6) for c in ("left_pct", "width_pct")})


@query(
    "confidence_bands",
    with_views(
        """SELECT subject, CASE WHEN confidence IS NULL THEN 'missing' WHEN confidence >= 0.7 THEN 'high'
             WHEN confidence >= 0.45 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM segments GROUP BY ALL""",
        "segments",
    ),
)
def confidence_bands(spark, sf_dir):
    return browse.confidence_bands(lib.segments(spark, sf_dir))
