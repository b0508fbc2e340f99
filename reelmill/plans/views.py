"""DuckDB text of the derived relations, for the check of every query against plain SQL."""

from __future__ import annotations

UUID_SQL = (
    "substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
    "translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12)"
)

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view(
    "videos0",
    [],
    """SELECT *, '/data/inbox/'||source||'/'||doc_id||'.'||
         CASE doc_id % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'MKV' WHEN 2 THEN 'mov' ELSE 'txt' END AS source_path
       FROM documents""",
)
_view(
    "videos1",
    ["videos0"],
    "SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source_path)) AS h FROM videos0",
)
_view(
    "videos",
    ["videos1"],
    f"""SELECT doc_id AS video_no, {UUID_SQL.format(h="h")} AS video_id, source_path, sha256(text) AS content_hash,
         n_chars AS file_size_bytes, n_chars/16.0::DOUBLE AS duration_sec, lang AS language,
         CASE WHEN doc_id % 10 = 7 THEN NULL ELSE doc_id % 3 <> 0 END AS has_speech,
         CASE doc_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'soft_deleted' WHEN 2 THEN 'queued'
              WHEN 3 THEN 'processing' ELSE 'done' END AS status,
         doc_id % 16 = 4 AS is_duplicate, 1704067200 + doc_id AS created_s
       FROM videos1""",
)
_view(
    "lines0",
    [],
    """SELECT doc_id AS video_no, i - 1 AS line_no, parts[i] AS line
       FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), range(1, len(parts) + 1) r(i)""",
)
_view(
    "transcript",
    ["lines0"],
    """SELECT video_no, line_no, (upto - length(line))/16.0::DOUBLE AS start_sec, upto/16.0::DOUBLE AS end_sec,
         trim(line) AS text
       FROM (SELECT *, sum(length(line)) OVER (PARTITION BY video_no ORDER BY line_no) AS upto FROM lines0)""",
)
_view(
    "frames",
    [],
    """SELECT user_id AS video_no, row_number() OVER w - 1 AS frame_no,
         (epoch_us(ts)//1000000 - min(epoch_us(ts)) OVER (PARTITION BY user_id)//1000000)/1024.0::DOUBLE AS time_sec,
         CASE event_type WHEN 'click' THEN 'teacher at a whiteboard' WHEN 'view' THEN 'student discussion'
           WHEN 'error' THEN 'laboratory experiment' WHEN 'signup' THEN 'slide presentation'
           WHEN 'purchase' THEN 'handwritten notes' END AS scene,
         ['obj'||(json_extract_string(props,'$.k')::BIGINT % 7)] AS objects, props AS ocr,
         CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS caption, event_id
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts), event_id)""",
)
_view(
    "frame_videos",
    [],
    """SELECT user_id AS video_no, (max(epoch_us(ts)//1000000) - min(epoch_us(ts)//1000000) + 1024)/1024.0::DOUBLE AS duration_sec,
         user_id % 2 = 0 AS is_silent FROM events GROUP BY user_id""",
)
_view(
    "levels",
    [],
    """SELECT user_id AS video_no, CASE WHEN event_id % 10 = 0 THEN '-inf'::DOUBLE ELSE -floor(value) END AS level_db FROM events""",
)
_view(
    "segments",
    [],
    """SELECT l_orderkey AS video_no, (row_number() OVER w - 1)::INTEGER AS seg_index,
         sum(l_quantity*4) OVER w - l_quantity*4 AS start_sec, sum(l_quantity*4) OVER w AS end_sec, p_name AS topic,
         CASE WHEN p_size % 11 = 0 THEN '' ELSE p_type END AS subject, p_brand AS grade_level,
         CASE p_size % 5 WHEN 0 THEN 'beginner' WHEN 1 THEN 'intermediate' WHEN 2 THEN 'advanced'
              WHEN 3 THEN 'expert' ELSE 'odd' END AS difficulty,
         string_split(p_name,' ') AS tags, (l_quantity % 17)/16.0::DOUBLE AS confidence
       FROM lineitem JOIN part ON l_partkey = p_partkey
       WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)""",
)
_view(
    "segment_videos",
    [],
    """SELECT o_orderkey AS video_no, CASE WHEN o_orderkey % 19 = 0 THEN 'soft_deleted' WHEN o_orderkey % 23 = 0 THEN 'failed'
         WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'queued' ELSE 'processing' END AS status,
         CASE WHEN o_orderkey % 10 = 7 THEN NULL ELSE o_orderkey % 3 <> 0 END AS has_speech,
         o_orderpriority AS language, epoch_us(o_orderdate)//1000000 AS created_s, o_custkey AS owner_no FROM orders""",
)
_view(
    "raw0",
    ["segments"],
    """SELECT *, (video_no + seg_index) % 6 AS kind, printf('%.4f', confidence) AS num,
         '{"topic": "'||topic||'", "subject": "'||subject||'", "grade_level": "'||grade_level||'", "difficulty": "'||difficulty
         ||'", "mood": "calm", "tags": ["'||array_to_string(tags,'", "')||'"]' AS head FROM segments""",
)
_view(
    "raw_answers",
    ["raw0"],
    """SELECT video_no, seg_index, video_no % 3 = 0 AS is_silent,
         CASE kind WHEN 0 THEN head||', "confidence": '||num||'}'
           WHEN 1 THEN '```json'||chr(10)||head||', "confidence": '||num||'}'||chr(10)||'```'
           WHEN 2 THEN head||', "confi' WHEN 3 THEN head||', "confidence": '||num
           WHEN 4 THEN 'I think this part is about '||topic
           ELSE head||', "confidence": "'||num||'"}' END AS raw_1,
         CASE WHEN kind = 4 THEN CASE WHEN video_no % 2 = 0 THEN head||'}' ELSE 'Sorry, no answer.' END END AS raw_2 FROM raw0""",
)
_view(
    "job_events",
    [],
    """SELECT user_id AS job_no, user_id % 50 AS video_no, event_id, epoch_us(ts) AS us,
         CASE event_type WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'enqueue' ELSE 'start' END WHEN 'view' THEN 'route' WHEN 'error' THEN 'failed'
           WHEN 'signup' THEN 'segmentation' WHEN 'purchase' THEN 'done' END AS stage, value AS seconds,
         CASE WHEN event_type = 'error' THEN CASE event_id % 13 WHEN 0 THEN ['RuntimeError','ConnectionResetError']
           WHEN 1 THEN ['ReadTimeout'] WHEN 2 THEN ['SoftTimeLimitExceeded'] ELSE ['ValueError'] END END AS error_chain,
         event_id % 7 AS retries FROM events""",
)
_view(
    "corpus",
    [],
    """SELECT doc_id AS video_no, 0 AS seg_index, CASE WHEN doc_id % 20 = 1 THEN 'soft_deleted' ELSE 'done' END AS status,
         source AS subject, lang AS grade_level, doc_id % 3 <> 0 AS has_speech, 0.0::DOUBLE AS start_sec, length(text)/16.0::DOUBLE AS end_sec,
         substr(text, 1, 20) AS topic, substr(text, 1, 60) AS summary, doc_id||'.mp4' AS source_name, text AS transcript_text,
         list_filter(regexp_split_to_array(lower(concat_ws(' ', coalesce(text, ''), substr(text, 1, 60), substr(text, 1, 20))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS tokens, embedding
       FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)""",
)
_view(
    "vectors",
    [],
    """SELECT vec_id AS video_no, 0 AS seg_index, 'label-'||label AS subject,
         CASE WHEN vec_id % 20 = 1 THEN 'soft_deleted' ELSE 'done' END AS status, vec_id % 3 <> 0 AS has_speech, embedding
       FROM embeddings""",
)

_view(
    "frame_segments",
    ["frame_videos"],
    """SELECT video_no, i::INTEGER AS seg_index, i*240.0::DOUBLE AS start_sec, least((i+1)*240.0::DOUBLE, duration_sec) AS end_sec, is_silent
       FROM frame_videos, range(0, floor(duration_sec/240)::BIGINT + 1) r(i)""",
)
_view(
    "transcript_segments",
    [],
    """SELECT doc_id AS video_no, i::INTEGER AS seg_index, i*60.0::DOUBLE AS start_sec, (i+1)*60.0::DOUBLE AS end_sec
       FROM documents, range(0, n_chars//960 + 1) r(i)""",
)

_view(
    "windows",
    ["transcript"],
    """SELECT video_no, window_no, window_no*30.0::DOUBLE AS start_sec, least((window_no+1)*30.0::DOUBLE, last_end) AS end_sec, text
       FROM (SELECT video_no, floor(start_sec/30)::BIGINT AS window_no, string_agg(text, ' ' ORDER BY line_no) AS text FROM transcript GROUP BY ALL)
       JOIN (SELECT video_no, arg_max(end_sec, line_no) AS last_end FROM transcript GROUP BY video_no) USING (video_no)
       WHERE regexp_matches(text, '\\S') AND window_no*30 < last_end""",
)
_view(
    "drops",
    ["windows"],
    """SELECT video_no, window_no, start_sec, end_sec, 1.0::DOUBLE - list_dot_product(e, lead(e) OVER (PARTITION BY video_no ORDER BY window_no)) AS drop
       FROM (SELECT w.*, embedding::DOUBLE[] AS e FROM windows w JOIN embeddings ON vec_id = (video_no*31 + window_no) % (SELECT count(*) FROM embeddings))""",
)
_view(
    "ranked_drops",
    ["drops"],
    """SELECT *, (high - drop)/nullif(high - low, 0) - (i - 1)::DOUBLE/nullif(n - 1, 0) AS d FROM (
         SELECT video_no, drop, row_number() OVER (PARTITION BY video_no ORDER BY drop DESC, window_no) AS i, count(*) OVER v AS n,
           min(drop) OVER v AS low, max(drop) OVER v AS high FROM drops WHERE drop IS NOT NULL WINDOW v AS (PARTITION BY video_no))""",
)
_view(
    "thresholds",
    ["ranked_drops"],
    """SELECT video_no, CASE WHEN k IS NULL THEN 0.25::DOUBLE ELSE greatest(k, 0.15::DOUBLE) END AS threshold
       FROM (SELECT video_no, arg_min(knee, i) FILTER (knee IS NOT NULL AND a < lev) AS k FROM (SELECT *, last_value(CASE WHEN is_min THEN 0.0::DOUBLE WHEN is_max THEN d - 1.0::DOUBLE/(n-1) END IGNORE NULLS) OVER r AS lev,
               last_value(CASE WHEN is_max THEN drop END IGNORE NULLS) OVER r AS knee
             FROM (SELECT *, d IS NOT NULL AND coalesce(d >= b, true) AND coalesce(d >= a, true) AS is_max,
                     d IS NOT NULL AND coalesce(d <= b, true) AND coalesce(d <= a, true) AS is_min
                   FROM (SELECT *, lag(d) OVER (PARTITION BY video_no ORDER BY i) AS b, lead(d) OVER (PARTITION BY video_no ORDER BY i) AS a
                         FROM ranked_drops))
             WINDOW r AS (PARTITION BY video_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
       GROUP BY video_no)""",
)
_view(
    "cuts",
    ["drops", "thresholds"],
    """SELECT video_no, min(start_sec) AS start_sec, max(end_sec) AS end_sec, any_value(n) AS n FROM (
         SELECT *, sum(o) OVER (PARTITION BY video_no ORDER BY window_no) AS g FROM (
           SELECT d.*, count(*) OVER (PARTITION BY video_no) AS n,
             CASE WHEN lag(drop) OVER (PARTITION BY video_no ORDER BY window_no) >= threshold THEN 1 ELSE 0 END AS o
           FROM drops d LEFT JOIN thresholds t USING (video_no))) WHERE n > 1 GROUP BY video_no, g""",
)
_view(
    "runs",
    ["frames", "frame_videos"],
    """SELECT r.video_no, CASE WHEN g = 1 THEN 0.0::DOUBLE ELSE t END AS start_sec,
         coalesce(lead(t) OVER (PARTITION BY r.video_no ORDER BY g), duration_sec) AS end_sec, scene
       FROM (SELECT video_no, g, min(time_sec) AS t, any_value(scene) AS scene FROM (
               SELECT *, sum(o) OVER (PARTITION BY video_no ORDER BY frame_no) AS g FROM (
                 SELECT *, CASE WHEN lag(frame_no) OVER w IS NULL OR scene IS DISTINCT FROM lag(scene) OVER w THEN 1 ELSE 0 END AS o
                 FROM frames WINDOW w AS (PARTITION BY video_no ORDER BY frame_no))) GROUP BY video_no, g) r
       JOIN frame_videos USING (video_no)""",
)


def segment_rules(
    cuts: str, durations: str | None, max_segments: int | None = 12, merge: bool = True, split: bool = True
) -> dict[str, str]:
    """The four rules as SQL over ``cuts``: a recursive left fold, a split, a recursive cap, and the coverage.

    The last relation, ``final_spans``, has one list ``l`` of ``{a, b}`` per video.
    """
    out = {
        "numbered": f"SELECT video_no, start_sec AS a, end_sec AS b, row_number() OVER (PARTITION BY video_no ORDER BY start_sec, end_sec) AS k FROM {cuts}",
        "fold": """SELECT video_no, k, a, b FROM numbered WHERE k = 1
          UNION ALL SELECT n.video_no, n.k, CASE WHEN n.b - n.a < 45 OR f.b - f.a < 45 THEN f.a ELSE n.a END, n.b
          FROM fold f JOIN numbered n ON n.video_no = f.video_no AND n.k = f.k + 1""",
        "merged": "SELECT video_no, a, max(b) AS b FROM fold GROUP BY video_no, a" if merge else "SELECT video_no, a, b FROM numbered",
        "sized": """SELECT *, least(greatest(round_even((b-a)/120, 0)::DOUBLE, 1), greatest(1, floor((b-a)/45)))::BIGINT AS n FROM merged""",
        "shaped": """SELECT video_no, a, b FROM sized WHERE b - a <= 120 OR n <= 1
          UNION ALL SELECT video_no, round_even(a + (k-1)*((b-a)/n), 2)::DOUBLE,
            CASE WHEN k = n THEN round_even(b, 2)::DOUBLE ELSE round_even(a + k*((b-a)/n), 2)::DOUBLE END
          FROM sized, range(1, n+1) r(k) WHERE b - a > 120 AND n > 1"""
        if split
        else "SELECT video_no, a, b FROM merged",
        "lists": "SELECT video_no, list({'a': a, 'b': b} ORDER BY a, b) AS l FROM shaped GROUP BY video_no",
    }
    if max_segments is None:
        out["capped"] = "SELECT video_no, l FROM lists"
    else:
        out["capping"] = f"""SELECT video_no, l FROM lists UNION ALL
          SELECT video_no, l[1:i-1] || [{{'a': l[i].a, 'b': l[i+1].b}}] || l[i+2:] AS l FROM (
            SELECT video_no, l, CASE WHEN m > 1 AND (m = len(l) OR w[m-1] <= w[m+1]) THEN m - 1 ELSE m END AS i FROM (
              SELECT video_no, l, w, list_position(w, list_min(w)) AS m FROM (
                SELECT video_no, l, list_transform(l, lambda x: x.b - x.a) AS w FROM capping WHERE len(l) > {max_segments})))"""
        out["capped"] = f"SELECT video_no, l FROM capping WHERE len(l) <= {max_segments}"
    if durations is None:
        out["final_spans"] = "SELECT video_no, l FROM capped"
    else:
        out["tails"] = f"""SELECT video_no, l, l[-1].a AS a, duration_sec AS dur, round_even(duration_sec, 2)::DOUBLE AS e,
            least(greatest(1, round_even((round_even(duration_sec, 2)::DOUBLE - l[-1].a)/120, 0)::DOUBLE),
                  greatest(1, floor((round_even(duration_sec, 2)::DOUBLE - l[-1].a)/45)))::BIGINT AS n
          FROM capped LEFT JOIN {durations} USING (video_no)"""
        out["final_spans"] = """SELECT video_no, CASE WHEN dur IS NULL OR dur = 0 OR l[-1].b >= dur - 1 THEN l
            WHEN e - a > 120 THEN l[1:len(l)-1] || list_transform(range(1, n+1), lambda k: {'a': round_even(a + (k-1)*((e-a)/n), 2)::DOUBLE,
              'b': CASE WHEN k = n THEN e ELSE round_even(a + k*((e-a)/n), 2)::DOUBLE END})
            ELSE l[1:len(l)-1] || [{'a': round_even(a, 2)::DOUBLE, 'b': e}] END AS l FROM tails"""
    return out


SPAN_ROWS = "SELECT video_no, (i-1)::INTEGER AS seg_index, l[i].a AS start_sec, l[i].b AS end_sec FROM final_spans, range(1, len(l)+1) r(i)"


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named relations, their inputs, and any extra CTEs."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        needs, sql = VIEWS[name]
        for n in needs:
            add(n)
        seen[name] = sql

    for n in names:
        add(n)
    seen.update(extra or {})
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({s})" for n, s in seen.items()) + "\n" + body
