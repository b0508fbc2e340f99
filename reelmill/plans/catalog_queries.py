"""Discovery, identity, de-duplication and registration over the derived library."""

from pyspark.sql import functions as F

from reelmill.functions.columns import stable_uuid
from reelmill.operators import catalog as op
from reelmill.plans import library as lib
from reelmill.plans.registry import query
from reelmill.plans.views import UUID_SQL, with_views
from reelmill.sources import documents

KNOWN = "('mp4','webm','mov','mkv','avi','m4v')"


@query(
    "discover_by_extension",
    with_views(
        f"""SELECT DISTINCT source_path, lower(split_part(source_path,'.',-1)) AS ext FROM videos
            WHERE lower(split_part(source_path,'.',-1)) IN {KNOWN}""",
        "videos",
    ),
)
def discover_by_extension(spark, sf_dir):
    return op.with_known_extension(lib.videos(spark, sf_dir))


@query(
    "select_rows_by_spec",
    with_views(
        "SELECT source_path, min(selector_no) AS selector_no FROM picks GROUP BY source_path",
        "videos",
        extra={
            "ranked": "SELECT DISTINCT source_path FROM videos",
            "picks": """SELECT source_path, 0 AS selector_no FROM (SELECT source_path FROM ranked ORDER BY source_path LIMIT 1 OFFSET 2)
              UNION ALL SELECT source_path, 1 FROM ranked WHERE lower(split_part(source_path,'/',-1)) = '12.mp4'
              UNION ALL SELECT source_path, 2 FROM ranked WHERE contains(lower(source_path), 'src7/')
              UNION ALL SELECT source_path, 3 FROM (SELECT source_path FROM ranked ORDER BY source_path LIMIT 1)""",
        },
    ),
)
def select_rows_by_spec(spark, sf_dir):
    return op.select_by_spec(lib.videos(spark, sf_dir), "3, 12.mp4, src7/, first")


@query(
    "content_hash",
    "SELECT doc_id, sha256(text) AS content_hash, octet_length(encode(text)) AS n_bytes FROM documents",
)
def content_hash(spark, sf_dir):
    return lib.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(F.col("text"), 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("n_bytes"),
    )


@query("stable_video_id", with_views("SELECT source_path, video_id FROM videos", "videos"))
def stable_video_id(spark, sf_dir):
    v = lib.videos(spark, sf_dir)
    return v.select("source_path", stable_uuid(F.col("source_path")).alias("video_id"))


@query(
    "skip_existing",
    with_views(
        """SELECT v.video_id, v.source_path FROM videos v
           WHERE NOT EXISTS (SELECT 1 FROM videos o WHERE o.video_no % 2 = 0 AND o.video_id = v.video_id)""",
        "videos",
    ),
)
def skip_existing(spark, sf_dir):
    v = lib.videos(spark, sf_dir)
    return op.skip_existing(v.select("video_id", "source_path"), v.where("video_no % 2 = 0"))


CANON = """(SELECT o.video_id FROM videos o WHERE o.video_no % 2 = 0 AND NOT o.is_duplicate AND o.status <> 'soft_deleted'
            AND o.content_hash = v.content_hash AND o.video_id <> v.video_id ORDER BY o.created_s, o.video_id LIMIT 1)"""


@query(
    "canonical_by_hash",
    with_views(f"SELECT v.video_id, v.content_hash, {CANON} AS canonical_video_id FROM videos v", "videos"),
)
def canonical_by_hash(spark, sf_dir):
    v = lib.videos(spark, sf_dir)
    return op.canonical_by_hash(v.select("video_id", "content_hash"), v.where("video_no % 2 = 0"))


@query(
    "exact_dedup",
    with_views(
        """SELECT video_id, content_hash, f <> video_id AS is_duplicate, CASE WHEN f <> video_id THEN f END AS canonical_video_id,
             CASE WHEN f <> video_id THEN 'done' ELSE status END AS status
           FROM (SELECT *, first_value(video_id) OVER (PARTITION BY content_hash ORDER BY created_s, video_id) AS f FROM videos)""",
        "videos",
    ),
)
def exact_dedup(spark, sf_dir):
    v = lib.videos(spark, sf_dir).select("video_id", "content_hash", "created_s", "status", "is_duplicate")
    return op.exact_dedup(v).drop("created_s")


VERDICT = f"""SELECT v.*, {CANON} AS canon, o.status AS old_status, o.is_duplicate AS old_dup
              FROM videos v LEFT JOIN (SELECT * FROM videos WHERE video_no % 2 = 0) o ON o.video_id = v.video_id"""


@query(
    "register_verdict",
    with_views(
        """SELECT video_id, source_path, content_hash, file_size_bytes, verdict,
             CASE WHEN verdict = 'duplicate' THEN canon END AS canonical_video_id,
             CASE verdict WHEN 'exists' THEN 'already processed (use force=true to reprocess)'
               WHEN 'duplicate' THEN 'byte-identical to an existing video' ELSE 'new content' END AS reason
           FROM (SELECT *, CASE WHEN old_status = 'done' AND NOT old_dup THEN 'exists' WHEN canon IS NOT NULL THEN 'duplicate'
                   ELSE 'queued' END AS verdict FROM judged)""",
        "videos",
        extra={"judged": VERDICT},
    ),
)
def register_verdict(spark, sf_dir):
    v = lib.videos(spark, sf_dir)
    return op.register_verdict(v, v.where("video_no % 2 = 0"))


@query(
    "register_batch_summary",
    with_views(
        f"""SELECT count(*) FILTER (NOT old) AS enqueued, 0::BIGINT AS duplicates, count(*) FILTER (old) AS skipped_existing,
              count(*) AS total
            FROM (SELECT v.video_id, coalesce(o.status = 'done', false) AS old FROM videos v
                  LEFT JOIN videos o ON o.video_id = v.video_id AND o.video_no % 2 = 0
                  WHERE lower(split_part(v.source_path,'.',-1)) IN {KNOWN})""",
        "videos",
    ),
)
def register_batch_summary(spark, sf_dir):
    v = lib.videos(spark, sf_dir)
    found = op.with_known_extension(v).select("source_path", stable_uuid(F.col("source_path")).alias("video_id"))
    return op.register_batch_summary(op.register_batch(found, v.where("video_no % 2 = 0")))


@query(
    "upsert_latest",
    with_views(
        """SELECT coalesce(n.video_id, o.video_id) AS video_id, CASE WHEN n.video_id IS NULL THEN o.status ELSE 'done' END AS status,
             CASE WHEN n.video_id IS NULL THEN o.is_duplicate ELSE false END AS is_duplicate,
             CASE WHEN n.video_id IS NULL THEN o.file_size_bytes ELSE n.file_size_bytes + 1 END AS file_size_bytes,
             coalesce(o.created_s, n.created_s + 1000000) AS created_s
           FROM (SELECT * FROM videos WHERE video_no % 2 = 0) o
           FULL JOIN (SELECT * FROM videos WHERE video_no % 3 = 0) n ON o.video_id = n.video_id""",
        "videos",
    ),
)
def upsert_latest(spark, sf_dir):
    v = lib.videos(spark, sf_dir).select("video_no", "video_id", "status", "is_duplicate", "file_size_bytes", "created_s")
    processed = v.where("video_no % 3 = 0").select(
        "video_id",
        F.lit("done").alias("status"),
        F.lit(False).alias("is_duplicate"),
        (F.col("file_size_bytes") + 1).alias("file_size_bytes"),
        (F.col("created_s") + 1_000_000).alias("created_s"),
    )
    return op.upsert_latest(v.where("video_no % 2 = 0").drop("video_no"), processed)


@query(
    "upsert_latest_whole",
    with_views(
        """SELECT o.video_id, CASE WHEN video_no % 3 = 0 THEN 'done' ELSE status END AS status,
             CASE WHEN video_no % 3 = 0 THEN false ELSE is_duplicate END AS is_duplicate,
             CASE WHEN video_no % 3 = 0 THEN file_size_bytes + 1 ELSE file_size_bytes END AS file_size_bytes, created_s FROM videos o
           UNION ALL SELECT video_id, 'done', false, file_size_bytes + 1, created_s + 1000000 FROM fresh""",
        "videos",
        extra={
            "hashed": """SELECT file_size_bytes, created_s, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source_path||'.new')) AS h
                FROM videos WHERE video_no % 5 = 0""",
            "fresh": f"SELECT {UUID_SQL.format(h='h')} AS video_id, file_size_bytes, created_s FROM hashed",
        },
    ),
)
def upsert_latest_whole(spark, sf_dir):
    """All videos are stored; every third has been processed again, and every fifth has a new neighbour that isn't stored yet."""
    v = lib.videos(spark, sf_dir)
    new_id = stable_uuid(F.concat("source_path", F.lit(".new")))
    incoming = v.where("video_no % 3 = 0").unionByName(v.where("video_no % 5 = 0").withColumn("video_id", new_id))
    processed = incoming.select(
        "video_id",
        F.lit("done").alias("status"),
        F.lit(False).alias("is_duplicate"),
        (F.col("file_size_bytes") + 1).alias("file_size_bytes"),
        (F.col("created_s") + 1_000_000).alias("created_s"),
    )
    return op.upsert_latest(v.select(processed.columns), processed)


@query(
    "mirror_changes",
    with_views(
        """SELECT video_id, CASE WHEN video_no % 5 = 0 THEN 'insert' WHEN video_no % 7 = 0 THEN 'delete' ELSE 'update' END AS change FROM videos
           WHERE (video_no % 5 = 0 AND video_no % 7 <> 0) OR (video_no % 5 <> 0 AND (video_no % 7 = 0 OR (video_no % 3 = 0 AND status <> 'failed')))""",
        "videos",
    ),
)
def mirror_changes(spark, sf_dir):
    """What a mirror of all videos must change: some come, some go, and some of the others have failed since."""
    v = lib.videos(spark, sf_dir)
    before, after = v.where("video_no % 5 <> 0"), v.where("video_no % 7 <> 0")
    after = after.withColumn("status", F.when(F.col("video_no") % 3 == 0, "failed").otherwise(F.col("status")))
    return op.change_feed(before, after)


@query(
    "replace_children",
    with_views(
        """SELECT video_no, seg_index, topic FROM segments WHERE video_no % 5 <> 0
           UNION ALL SELECT video_no, seg_index, upper(topic) FROM segments WHERE video_no % 5 = 0 AND seg_index % 2 = 0""",
        "segments",
    ),
)
def replace_children(spark, sf_dir):
    s = lib.segments(spark, sf_dir).select("video_no", "seg_index", "topic")
    new = s.where("video_no % 5 = 0 AND seg_index % 2 = 0").withColumn("topic", F.upper("topic"))
    return op.replace_children(s, new, "video_no")


@query(
    "soft_delete",
    with_views(
        """SELECT video_id, source_path, CASE WHEN status = 'failed' THEN 'soft_deleted' ELSE status END AS status FROM videos""",
        "videos",
    ),
)
def soft_delete(spark, sf_dir):
    v = lib.videos(spark, sf_dir).select("video_id", "source_path", "status")
    return op.soft_delete(v, v.where("status = 'failed'"))


@query(
    "apply_failures",
    with_views(
        """SELECT v.video_id, CASE WHEN v.status = 'processing' THEN 'failed' ELSE v.status END AS status,
             CASE WHEN v.status = 'processing' THEN substr(d.text, 1, 2000) END AS error_message
           FROM videos v JOIN documents d ON d.doc_id = v.video_no""",
        "videos",
    ),
)
def apply_failures(spark, sf_dir):
    v = lib.videos(spark, sf_dir).select("video_no", "video_id", "status", F.lit(None).cast("string").alias("error_message"))
    docs = lib.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_no"), F.col("text").alias("message"))
    failures = v.where("status = 'processing'").select("video_no", "video_id").join(docs, "video_no")
    return op.apply_failures(v.drop("video_no"), failures)


@query(
    "safe_stem",
    with_views(
        """SELECT video_id, source_path, stem, count(*) OVER (PARTITION BY stem) AS n_same_stem
           FROM (SELECT video_id, url AS source_path, coalesce(nullif(regexp_replace(regexp_replace(
               regexp_replace(split_part(url,'/',-1), '^(.+)\\.[^.]+$', '\\1'), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''),
               'results_'||substr(video_id,1,8)) AS stem FROM named)""",
        extra={
            "hashed": "SELECT url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages",
            "named": """SELECT url, substr(h,1,8)||'-'||substr(h,9,4)||'-5'||substr(h,14,3)||'-'||
                translate(substr(h,17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr(h,18,3)||'-'||substr(h,21,12) AS video_id
                FROM hashed""",
        },
    ),
)
def safe_stem(spark, sf_dir):
    pages = lib.table(spark, sf_dir, "pages").select(
        stable_uuid(F.col("url")).alias("video_id"), F.col("url").alias("source_path")
    )
    return op.document_names(pages)


@query(
    "register_arrivals",
    with_views(
        """SELECT video_id, source_path, content_hash, file_size_bytes, CASE WHEN canon IS NULL THEN 'queued' ELSE 'done' END AS status,
             canon IS NOT NULL AS is_duplicate, canon AS canonical_video_id, created_s
           FROM (SELECT *, nullif(coalesce(root, first_value(video_id) OVER (PARTITION BY content_hash, root IS NULL ORDER BY created_s, video_id)),
                   video_id) AS canon FROM open_items)""",
        "videos",
        extra={
            "old": "SELECT * FROM videos WHERE video_no % 2 = 0",
            "roots": """SELECT content_hash, arg_min(video_id, (created_s, video_id)) AS root FROM old
                WHERE NOT is_duplicate AND status <> 'soft_deleted' GROUP BY content_hash""",
            "open_items": """SELECT v.*, r.root FROM videos v LEFT JOIN roots r USING (content_hash)
                WHERE v.video_id NOT IN (SELECT video_id FROM old WHERE status = 'done' AND NOT is_duplicate)""",
        },
    ),
)
def register_arrivals(spark, sf_dir):
    v = lib.videos(spark, sf_dir)
    arriving = v.select("video_id", "source_path", "content_hash", "file_size_bytes", "created_s")
    return op.register_arrivals(arriving, v.where("video_no % 2 = 0"))


@query(
    "export_incremental",
    with_views(
        """SELECT stem, arg_max(video_id, (batch, video_id)) AS video_id, arg_max(file_size_bytes, (batch, video_id)) AS file_size_bytes
           FROM (SELECT (video_no // 3)::VARCHAR AS stem, video_no % 2 AS batch, * FROM videos) GROUP BY stem""",
        "videos",
    ),
)
def export_incremental(spark, sf_dir):
    """Two batches (even and odd items) whose names overlap: the second replaces documents of the first that share a stem."""
    name = F.concat(F.lit("/out/"), F.floor(F.col("video_no") / 3).cast("string"), F.lit(".mp4"))
    v = lib.videos(spark, sf_dir).withColumn("source_path", name)
    stored = documents.latest_by_stem(v.where("video_no % 2 = 0")).select("stem", "video_id", "file_size_bytes")
    return documents.export_incremental(stored, v.where("video_no % 2 = 1"))
