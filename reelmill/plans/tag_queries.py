"""Tag normalisation over raw model answers and tagged segments."""

from pyspark.sql import functions as F

from reelmill.operators import tags as op
from reelmill.operators.segmentation import attach_frame_signals, attach_transcript
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import with_views


def body_sql(raw: str) -> str:
    return f"""nullif(regexp_extract(regexp_replace(trim(coalesce({raw}, '')), '^\\s*```(?:json)?|```\\s*$', '', 'g'), '(\\{{.*)', 1, 's'), '')"""


def parse_sql(source: str, raw: str) -> dict[str, str]:
    """Closing candidates, the strict object ``j``, and the regular-expression fallback, as SQL."""
    p = f"p_{raw}"
    cands = ["b", "b||'}'", "b||'\"}'", "b||'\"}}'", "nullif(regexp_extract(b, '^(.*\\})', 1, 's'), '')"]
    picked = " ".join(f"WHEN json_valid({c}) THEN {c}" for c in cands)

    def grab(k: str, pat: str = '"([^"]*)"') -> str:
        rx = f"'\"{k}\"\\s*:\\s*{pat}'"
        return f"CASE WHEN regexp_matches(b, {rx}) THEN regexp_extract(b, {rx}, 1) END"

    def items(k: str) -> str:
        rx = f"'\"{k}\"\\s*:\\s*\\[(.*?)\\]'"
        return f"""CASE WHEN regexp_matches(b, {rx}, 's') THEN list_filter(list_transform(string_split(regexp_extract(b, {rx}, 1, 's'), ','),
          lambda x: trim(trim(x), '"')), lambda x: x <> '') END"""

    names = ["topic", "subject", "grade_level", "difficulty"]
    fields = ", ".join(
        f"CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.{k}') ELSE {grab(k)} END AS {k}" for k in names
    )
    number = grab("confidence", "([0-9]*\\.?[0-9]+)")
    return {
        f"{p}_body": f"SELECT *, {body_sql(raw)} AS b FROM {source}",
        f"{p}_json": f"SELECT *, CASE {picked} END AS j FROM {p}_body",
        p: f"""SELECT video_no, seg_index, is_silent, {raw} AS raw, CASE WHEN j IS NOT NULL THEN 'strict'
             WHEN nullif(topic, '') IS NOT NULL THEN 'recovered' ELSE 'error' END AS status, topic, subject, grade_level, difficulty, conf,
             tags, mood FROM (SELECT *, {fields},
               CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.confidence') ELSE {number} END AS conf,
               CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.tags[*]') ELSE {items("tags")} END AS tags,
               CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.mood') END AS mood FROM {p}_json)""",
    }


def typed_sql(source: str) -> str:
    def keep(c: str) -> str:
        return f"CASE WHEN status <> 'error' THEN {c} END"

    conf = "coalesce(round_even(try_cast(conf AS DOUBLE), 2)::DOUBLE, CASE WHEN is_silent THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END)"
    capped = f"CASE WHEN is_silent THEN least({conf}, 0.6::DOUBLE) ELSE {conf} END"
    return f"""SELECT video_no, seg_index, is_silent, status, CASE WHEN status = 'error' THEN substr(raw, 1, 300) END AS error,
        {keep("topic")} AS topic, {keep("subject")} AS subject, {keep("grade_level")} AS grade_level, {keep("difficulty")} AS difficulty,
        {keep("array_to_string(coalesce(tags, []), '|')")} AS tags, {keep(capped)} AS confidence,
        {keep("try_cast(conf AS DOUBLE) IS NULL")} AS confidence_defaulted, mood FROM {source}"""


TYPED = ["status", "error", "topic", "subject", "grade_level", "difficulty", "tags", "confidence", "confidence_defaulted", "mood"]
P1 = parse_sql("raw_answers", "raw_1")
P2 = parse_sql("(SELECT * FROM raw_answers WHERE raw_2 IS NOT NULL)", "raw_2")
MERGED = {
    "t1": typed_sql("p_raw_1"),
    "t2": typed_sql("p_raw_2"),
    "merged": f"""SELECT t1.video_no, t1.seg_index, coalesce(t1.status = 'error' AND t2.status <> 'error', false) AS retried,
        {", ".join(f"CASE WHEN t1.status = 'error' AND t2.status <> 'error' THEN t2.{c} ELSE t1.{c} END AS {c}" for c in TYPED)}
        FROM t1 LEFT JOIN t2 USING (video_no, seg_index)""",
}


def flat(df, *more):
    """Lists and leftovers as text."""
    return df.select(
        "video_no",
        "seg_index",
        *more,
        *[c for c in TYPED if c not in ("tags", "mood")],
        F.array_join("tags", "|").alias("tags"),
        F.col("extra")["mood"].alias("mood"),
    )


@query(
    "parse_model_json",
    with_views(
        """SELECT video_no, seg_index, status, CASE WHEN status = 'error' THEN substr(raw, 1, 300) END AS error, topic, subject,
             grade_level, difficulty, conf AS confidence_text, array_to_string(tags, '|') AS tags FROM p_raw_1""",
        "raw_answers",
        extra=P1,
    ),
)
def parse_model_json(spark, sf_dir):
    p = op.with_parsed(lib.raw_answers(spark, sf_dir), "raw_1", "p").select("video_no", "seg_index", "p.*")
    return p.select(
        "video_no",
        "seg_index",
        "status",
        "error",
        *[F.col("fields")[k].alias(k) for k in ("topic", "subject", "grade_level", "difficulty")],
        F.col("fields")["confidence"].alias("confidence_text"),
        F.array_join("tags", "|").alias("tags"),
    )


@query(
    "finalize_tags",
    with_views(f"SELECT video_no, seg_index, {', '.join(TYPED)} FROM t1", "raw_answers", extra=P1 | {"t1": MERGED["t1"]}),
)
def finalize_tags(spark, sf_dir):
    p = op.with_parsed(lib.raw_answers(spark, sf_dir), "raw_1", "p")
    typed = p.withColumn("t", op.finalize_tags(F.col("p"), F.col("is_silent")))
    return flat(typed.select("video_no", "seg_index", "t.*"))


@query("retry_merge", with_views("SELECT * FROM merged", "raw_answers", extra=P1 | P2 | MERGED))
def retry_merge(spark, sf_dir):
    return flat(op.tag_answers(lib.raw_answers(spark, sf_dir)), "retried")


@query(
    "parse_status_report",
    with_views(
        """SELECT status, count(*) AS n, count(*) FILTER (retried) AS retried, count(*) FILTER (confidence_defaulted) AS defaulted
           FROM merged GROUP BY status""",
        "raw_answers",
        extra=P1 | P2 | MERGED,
    ),
)
def parse_status_report(spark, sf_dir):
    return op.parse_status_report(op.tag_answers(lib.raw_answers(spark, sf_dir)))


RECOVER = parse_sql("stored", "parse_error")


@query(
    "recover_failed_rows",
    with_views(
        """SELECT video_no, seg_index, CASE WHEN status = 'strict' THEN topic ELSE nullif(topic, '') END AS topic,
             CASE WHEN status = 'strict' THEN subject ELSE nullif(subject, '') END AS subject,
             CASE WHEN status = 'strict' THEN grade_level ELSE nullif(grade_level, '') END AS grade_level,
             array_to_string(coalesce(tags, []), '|') AS tags FROM p_parse_error""",
        "raw_answers",
        extra={
            "stored": """SELECT video_no, seg_index, is_silent, substr(raw_1, 1, 300) AS parse_error FROM raw_answers
                WHERE (video_no + seg_index) % 6 BETWEEN 2 AND 4"""
        }
        | RECOVER,
    ),
)
def recover_failed_rows(spark, sf_dir):
    kind = (F.col("video_no") + F.col("seg_index")) % 6
    stored = lib.raw_answers(spark, sf_dir).select(
        "video_no", "seg_index", F.when(kind.between(2, 4), F.substring("raw_1", 1, 300)).alias("parse_error")
    )
    out = op.recover_failed_rows(stored)
    return out.select("video_no", "seg_index", "topic", "subject", "grade_level", F.array_join("tags", "|").alias("tags"))


@query(
    "project_typed_columns",
    with_views(
        """SELECT video_no, seg_index, topic, subject, grade_level, difficulty, confidence, coalesce(tags, '') AS tags, concat_ws(',',
             CASE WHEN mood IS NOT NULL THEN 'mood='||mood END, CASE WHEN status = 'error' THEN '_parse_error='||coalesce(error, '') END,
             CASE WHEN status = 'recovered' THEN '_recovered=true' END, CASE WHEN retried THEN '_retried=true' END,
             CASE WHEN confidence_defaulted THEN 'confidence_defaulted=true' END, 'scenes=[],objects=[],captions=[]') AS llm_extra,
             64 AS dim, 0.0::DOUBLE AS vector_sum FROM merged""",
        "raw_answers",
        extra=P1 | P2 | MERGED,
    ),
)
def project_typed_columns(spark, sf_dir):
    rows = op.project_typed_columns(op.tag_answers(lib.raw_answers(spark, sf_dir)), dim=64)
    extra = F.transform(F.map_entries("llm_extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select(
        "video_no",
        "seg_index",
        "topic",
        "subject",
        "grade_level",
        "difficulty",
        "confidence",
        F.array_join("tags", "|").alias("tags"),
        F.array_join(extra, ",").alias("llm_extra"),
        F.size("embedding").alias("dim"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x).alias("vector_sum"),
    )


def dominant_sql(col: str, out: str) -> str:
    return f"""SELECT video_no, CASE WHEN count(*) FILTER (n = m) > 1 THEN arg_max(v, best) ELSE arg_max(v, n) END AS {out}
      FROM (SELECT *, max(n) OVER (PARTITION BY video_no) AS m FROM (SELECT video_no, {col} AS v, count(*) AS n,
        max((coalesce(confidence, 0), -seg_index)) AS best FROM segments WHERE {col} <> '' GROUP BY video_no, {col})) GROUP BY video_no"""


DOMINANT = {"ds": dominant_sql("subject", "dominant_subject"), "dg": dominant_sql("grade_level", "dominant_grade")}


@query(
    "dominant_value",
    with_views(
        "SELECT video_no, dominant_subject, dominant_grade FROM ds FULL JOIN dg USING (video_no)", "segments", extra=DOMINANT
    ),
)
def dominant_value(spark, sf_dir):
    return op.dominant_value(lib.segments(spark, sf_dir))


@query(
    "consistency_pass",
    with_views(
        """SELECT video_no, seg_index, CASE WHEN subject <> '' AND dominant_subject IS NOT NULL THEN dominant_subject ELSE subject END AS subject,
             CASE WHEN grade_level <> '' THEN dominant_grade ELSE grade_level END AS grade_level,
             CASE WHEN subject <> '' AND subject <> dominant_subject THEN subject END AS subject_raw,
             CASE WHEN grade_level <> '' AND grade_level <> dominant_grade THEN grade_level END AS grade_level_raw
           FROM segments LEFT JOIN ds USING (video_no) LEFT JOIN dg USING (video_no)""",
        "segments",
        extra=DOMINANT,
    ),
)
def consistency_pass(spark, sf_dir):
    s = lib.segments(spark, sf_dir).select("video_no", "seg_index", "subject", "grade_level", "confidence", "start_sec", "end_sec")
    return op.consistency_pass(s).select("video_no", "seg_index", "subject", "grade_level", "subject_raw", "grade_level_raw")


SEEN = {
    "seen": """SELECT s.video_no, s.seg_index, s.is_silent, coalesce(string_agg(DISTINCT f.scene, ', ' ORDER BY f.scene), '') AS scenes,
        coalesce(string_agg(DISTINCT f.objects[1], ', ' ORDER BY f.objects[1]), '') AS objects,
        coalesce(substr(string_agg(f.ocr, ' ' ORDER BY f.frame_no), 1, 600), '') AS ocr,
        coalesce(array_to_string((list(f.caption ORDER BY f.frame_no) FILTER (f.caption <> ''))[1:4], ', '), '') AS captions
        FROM frame_segments s LEFT JOIN frames f ON f.video_no = s.video_no AND f.time_sec >= s.start_sec AND f.time_sec < s.end_sec GROUP BY ALL""",
    "heard": """SELECT s.video_no, s.seg_index, coalesce(string_agg(t.text, ' ' ORDER BY t.line_no), '') AS text FROM frame_segments s
        LEFT JOIN transcript t ON t.video_no = s.video_no AND t.start_sec >= s.start_sec AND t.start_sec < s.end_sec GROUP BY ALL""",
}


def _full_segments(spark, sf_dir):
    segs = attach_frame_signals(lib.frame_segments(spark, sf_dir), lib.frames(spark, sf_dir))
    return attach_transcript(segs, lib.transcript(spark, sf_dir))


@query(
    "prompt_inputs",
    with_views(
        """SELECT video_no, seg_index, CASE WHEN is_silent THEN 'screen text: '||substr(ocr,1,400)||chr(10)||'captions: '||captions||chr(10)
               ||'scenes: '||scenes||'; objects: '||objects
             ELSE 'transcript: '||substr(text,1,3000)||chr(10)||'screen text: '||substr(ocr,1,300)||chr(10)||'weak hints: '
               ||'scenes: '||scenes||'; objects: '||objects END AS evidence FROM seen JOIN heard USING (video_no, seg_index)""",
        "frames",
        "frame_segments",
        "transcript",
        extra=SEEN,
    ),
)
def prompt_inputs(spark, sf_dir):
    return op.prompt_inputs(_full_segments(spark, sf_dir))


@query(
    "rule_tagger",
    with_views(
        """SELECT video_no, seg_index, CASE WHEN len(w) = 0 THEN 'Sample Lesson' ELSE array_to_string(list_transform(w[1:4],
               lambda x: array_to_string(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 OR x[i-1] IN ('-', '''') THEN upper(x[i])
                 ELSE lower(x[i]) END), '')), ' ') END AS topic,
             array_to_string(list_transform(w[1:3], lambda x: lower(x)), '|') AS subtopics,
             array_to_string(list_transform(w[1:5], lambda x: lower(x)), '|') AS tags,
             CASE WHEN is_silent THEN 'animation' ELSE 'lecture' END AS content_type,
             CASE WHEN is_silent THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS confidence
           FROM (SELECT *, regexp_extract_all(CASE WHEN is_silent THEN regexp_extract(substr(ocr,1,400), '^[\\t-\\r ]*([^\\n]*)', 1) ELSE substr(text,1,3000) END,
                   '[A-Za-z][A-Za-z''-]+')[1:6] AS w FROM seen JOIN heard USING (video_no, seg_index))""",
        "frames",
        "frame_segments",
        "transcript",
        extra=SEEN,
    ),
)
def rule_tagger(spark, sf_dir):
    out = op.rule_tagger(_full_segments(spark, sf_dir))
    return out.select(
        "video_no",
        "seg_index",
        "topic",
        F.array_join("subtopics", "|").alias("subtopics"),
        F.array_join("tags", "|").alias("tags"),
        "content_type",
        "confidence",
    )
