"""Speech, route and frame queries."""

from pyspark.sql import functions as F

from reelmill.operators import frames as fr
from reelmill.operators import speech as sp
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import with_views

LEVEL_SQL = """SELECT doc_id AS video_no, round_even(coalesce(m, -99.0::DOUBLE), 1)::DOUBLE AS mean_level_db,
    coalesce(m, -99.0::DOUBLE) > -50 AS has_speech FROM documents LEFT JOIN
    (SELECT video_no, avg(level_db) FILTER (isfinite(level_db)) AS m FROM levels GROUP BY video_no) ON video_no = doc_id"""


@query("mean_level_db", with_views(LEVEL_SQL, "levels"))
def mean_level_db(spark, sf_dir):
    return sp.mean_level_db(lib.videos(spark, sf_dir), lib.levels(spark, sf_dir))


TRANSCRIPT_SQL = """SELECT video_no, trim(string_agg(text, ' ' ORDER BY line_no)) AS full_text,
    round_even(sum(end_sec - start_sec), 1)::DOUBLE AS speech_sec FROM transcript GROUP BY video_no"""


@query("transcript_agg", with_views(TRANSCRIPT_SQL, "transcript"))
def transcript_agg(spark, sf_dir):
    return sp.transcript_agg(lib.transcript(spark, sf_dir))


@query(
    "speech_features",
    with_views(
        """SELECT doc_id AS video_no, round_even(w/greatest(n_chars/16.0::DOUBLE/60, 1e-6::DOUBLE), 1)::DOUBLE AS words_per_minute,
             round_even(1 - s/greatest(n_chars/16.0::DOUBLE, 1e-6::DOUBLE), 3)::DOUBLE AS silence_ratio,
             round_even(e, 4)::DOUBLE AS mean_energy
           FROM documents JOIN (SELECT video_no, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS w,
             sum(CASE WHEN length(text) > 20 THEN end_sec - start_sec ELSE 0 END) AS s, avg(length(text)/1024.0::DOUBLE) AS e
             FROM transcript GROUP BY video_no) ON video_no = doc_id""",
        "transcript",
    ),
)
def speech_features(spark, sf_dir):
    lines = lib.transcript(spark, sf_dir).withColumns(
        {"voiced": F.length("text") > 20, "energy": F.length("text") / 1024}
    )
    return sp.speech_features(lib.videos(spark, sf_dir), lines)


@query(
    "route_videos",
    with_views(
        """SELECT l.video_no, has_speech, mean_level_db, speech_sec, CASE WHEN s THEN 'silent' ELSE 'voice' END AS path,
             CASE WHEN s THEN 40 ELSE 18 END AS max_frames, s AS ocr_all_frames, s AS force_captions,
             CASE WHEN s THEN 'no narration (rms='||mean_level_db||'dB, speech='||speech_sec||'s)'
               ELSE 'narration present (speech='||speech_sec||'s)' END AS reason
           FROM (SELECT l.*, t.speech_sec, NOT l.has_speech OR t.speech_sec < 3 AS s FROM lev l JOIN tr t USING (video_no)) l""",
        "levels",
        "transcript",
        extra={
            "lev": LEVEL_SQL,
            "tr": "SELECT video_no, round_even(sum(end_sec - start_sec), 1)::DOUBLE AS speech_sec FROM transcript GROUP BY video_no",
        },
    ),
)
def route_videos(spark, sf_dir):
    levels = sp.mean_level_db(lib.videos(spark, sf_dir), lib.levels(spark, sf_dir))
    speech = sp.transcript_agg(lib.transcript(spark, sf_dir)).drop("full_text")
    return sp.route_videos(levels.join(speech, "video_no"))


@query(
    "plan_frame_times",
    with_views(
        """SELECT video_no, unnest(CASE WHEN len(t) = 0 THEN [0.0::DOUBLE] WHEN len(t) <= cap THEN t
             ELSE list_transform(range(0, cap), lambda i: t[floor(i * (len(t)/cap::DOUBLE))::BIGINT + 1]) END) AS time_sec
           FROM (SELECT v.video_no, v.cap, list_sort(list_distinct(list_filter(
               list_transform(range(1, v.n + 1), lambda i: round_even(v.duration_sec*i/(v.n + 1), 2)::DOUBLE) || coalesce(c.t, []),
               lambda x: x >= 0 AND x <= v.duration_sec))) AS t
             FROM (SELECT *, least(cap, greatest(4, floor(duration_sec/30)::BIGINT + 1)) AS n FROM
               (SELECT *, CASE WHEN is_silent THEN 40 ELSE 18 END AS cap FROM frame_videos)) v
             LEFT JOIN (SELECT video_no, list(round_even(time_sec, 2)::DOUBLE) AS t FROM frames WHERE event_id % 10 > 3 GROUP BY video_no) c
             USING (video_no))""",
        "frames",
        "frame_videos",
    ),
)
def plan_frame_times(spark, sf_dir):
    cap = F.when(F.col("is_silent"), 40).otherwise(18)
    videos = lib.frame_videos(spark, sf_dir).withColumn("max_frames", cap)
    cuts = lib.frames(spark, sf_dir).select("video_no", "time_sec", ((F.col("event_id") % 10) / 10).alias("score"))
    return fr.plan_frame_times(videos, cuts)


@query(
    "zero_shot_label",
    """WITH c AS (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings)
         GROUP BY ALL),
       l AS (SELECT label, list(round_even(m, 6)::DOUBLE ORDER BY i) AS vec FROM c GROUP BY label),
       s AS (SELECT e.vec_id, l.label, list_dot_product(e.embedding::DOUBLE[], l.vec)*10 AS sim FROM embeddings e, l),
       b AS (SELECT vec_id, max(sim) AS top, arg_max(label, (sim, -label)) AS label FROM s GROUP BY vec_id)
       SELECT b.vec_id, 'label-'||b.label AS scene, round_even(1/sum(exp(s.sim - b.top)), 3)::DOUBLE AS scene_conf
       FROM b JOIN s USING (vec_id) GROUP BY b.vec_id, b.label""",
)
def zero_shot_label(spark, sf_dir):
    emb = lib.table(spark, sf_dir, "embeddings")
    labels = lib.label_centroids(spark, sf_dir)
    return fr.zero_shot_label(emb.select("vec_id", "embedding"), labels, scale=10.0)


@query(
    "gate_frames",
    with_views(
        """SELECT video_no, frame_no, real AS run_detector, is_silent OR NOT real AS run_ocr,
             CASE WHEN real THEN objects[1] ELSE '' END AS objects, CASE WHEN is_silent OR NOT real THEN ocr ELSE '' END AS ocr
           FROM (SELECT *, scene IN ('laboratory experiment','teacher at a whiteboard','student discussion') AS real
                 FROM frames JOIN frame_videos USING (video_no))""",
        "frames",
        "frame_videos",
    ),
)
def gate_frames(spark, sf_dir):
    frames = lib.frames(spark, sf_dir).join(lib.frame_videos(spark, sf_dir).drop("duration_sec"), "video_no")
    return fr.apply_gate(frames).select(
        "video_no", "frame_no", "run_detector", "run_ocr", F.array_join("objects", "|").alias("objects"), "ocr"
    )


@query(
    "caption_sample",
    with_views(
        """SELECT f.video_no, f.frame_no, f.time_sec FROM frames f JOIN (SELECT video_no, greatest(1, count(*)//12) AS step FROM frames
           GROUP BY video_no) s USING (video_no) JOIN frame_videos v USING (video_no)
           WHERE v.is_silent AND f.frame_no % s.step = 0 AND f.frame_no//s.step < 12""",
        "frames",
        "frame_videos",
    ),
)
def caption_sample(spark, sf_dir):
    frames = lib.frames(spark, sf_dir).select("video_no", "frame_no", "time_sec")
    return fr.caption_sample(frames, lib.frame_videos(spark, sf_dir))


@query("scene_distribution", with_views("SELECT video_no, scene, count(*) AS n FROM frames GROUP BY ALL", "frames"))
def scene_distribution(spark, sf_dir):
    return fr.scene_distribution(lib.frames(spark, sf_dir))
