"""A lesson library derived from the given tables.

Every relation the operators need (items, transcript lines, frames, level samples, segments, raw model answers, job events,
searchable corpus) is computed by Spark from whole input tables, so the work of a query grows with them.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.columns import epoch_micros, round_even, stable_uuid
from reelmill.functions.materialize import new_table_path
from reelmill.functions.ordered import Ordered, find_heavy, ordered_scan
from reelmill.operators.codes import build_codes
from reelmill.operators.postings import build_index
from reelmill.operators.search import with_tokens
from reelmill.sources.files import spread

# Scene labels given to the five event types.
SCENE_OF_EVENT = {
    "click": "teacher at a whiteboard",
    "view": "student discussion",
    "error": "laboratory experiment",
    "signup": "slide presentation",
    "purchase": "handwritten notes",
}

# Stage and outcome names given to the five event types.
STAGE_OF_EVENT = {
    "click": "start",
    "view": "route",
    "error": "failed",
    "signup": "segmentation",
    "purchase": "done",
}

# Segments that one task numbers and sums up; a segment becomes about a dozen values of its video there.
SEGMENT_ROWS = 100_000

# Characters of documents whose lines one task numbers and joins; with one more per document they bound its lines too.
TEXT_CHARS = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread over the cores when the scan has fewer partitions than there are cores."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item per document; even numbers play the stored catalogue, odd ones the incoming batch."""
    n = F.col("doc_id")
    ext = F.element_at(F.array(F.lit("mp4"), F.lit("MKV"), F.lit("mov"), F.lit("txt")), (n % 4 + 1).cast("int"))
    status = (
        F.when(n % 20 == 0, "failed")
        .when(n % 20 == 1, "soft_deleted")
        .when(n % 20 == 2, "queued")
        .when(n % 20 == 3, "processing")
        .otherwise("done")
    )
    path = F.concat(F.lit("/data/inbox/"), F.col("source"), F.lit("/"), n.cast("string"), F.lit("."), ext)
    return table(spark, sf_dir, "documents").select(
        n.alias("video_no"),
        stable_uuid(path).alias("video_id"),
        path.alias("source_path"),
        F.sha2(F.col("text"), 256).alias("content_hash"),
        F.col("n_chars").alias("file_size_bytes"),
        (F.col("n_chars") / 16).alias("duration_sec"),
        F.col("lang").alias("language"),
        F.when(n % 10 == 7, F.lit(None).cast("boolean")).otherwise(n % 3 != 0).alias("has_speech"),
        status.alias("status"),
        (n % 16 == 4).alias("is_duplicate"),
        (F.lit(1_704_067_200) + n).alias("created_s"),
    )


def transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-stamped lines of every document; 16 characters take one second.

    Documents are dealt by id once, into parts of about ``TEXT_CHARS`` whatever the scan and the table are like, so numbering their lines and all
    that is grouped by video later needs no other shuffle, and a task's memory doesn't grow with the table.
    """
    docs = table(spark, sf_dir, "documents")
    size = docs.agg(F.sum(F.coalesce("n_chars", F.lit(0)) + 1)).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-size // TEXT_CHARS))
    lines = docs.repartition(parts, "doc_id").select(
        F.col("doc_id").alias("video_no"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    )
    timed = ordered_scan(
        lines,
        ["video_no"],
        [F.col("line_no")],
        F.floor(F.col("line_no") / 4096),
        [Ordered("upto", "sum", F.length("line"))],
        heavy=None,  # the lines of a document come from one row, so the group is never larger than that row
    )
    return timed.select(
        "video_no",
        "line_no",
        ((F.col("upto") - F.length("line")) / 16).alias("start_sec"),
        (F.col("upto") / 16).alias("end_sec"),
        F.trim("line").alias("text"),
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled frames, one per event; a user's events are the frames of one video."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_no"),
        "event_id",
        epoch_micros(F.col("ts")).alias("us"),
        "event_type",
        "props",
    )
    numbered = ordered_scan(
        ev,
        ["video_no"],
        [F.col("us"), F.col("event_id")],
        F.floor(F.col("us") / 3_600_000_000),
        [Ordered("frame_no", "row_number"), Ordered("first_us", "min_all", F.col("us"))],
    )
    labels = F.create_map(*[F.lit(x) for kv in SCENE_OF_EVENT.items() for x in kv])
    k = F.get_json_object("props", "$.k").cast("long")
    return numbered.select(
        "video_no",
        (F.col("frame_no") - 1).alias("frame_no"),
        ((F.floor(F.col("us") / 1_000_000) - F.floor(F.col("first_us") / 1_000_000)) / 1024).alias("time_sec"),
        labels[F.col("event_type")].alias("scene"),
        F.array(F.concat(F.lit("obj"), (k % 7).cast("string"))).alias("objects"),
        F.col("props").alias("ocr"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("caption"),
        "event_id",
    )


def frame_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and route of the videos the frames belong to."""
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_no"), F.floor(epoch_micros(F.col("ts")) / 1_000_000).alias("s")
    )
    return ev.groupBy("video_no").agg(
        ((F.max("s") - F.min("s") + 1024) / 1024).alias("duration_sec"), (F.col("video_no") % 2 == 0).alias("is_silent")
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio level samples in dB; every tenth one is digital silence."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_no"),
        F.when(F.col("event_id") % 10 == 0, F.lit(float("-inf"))).otherwise(-F.floor("value").cast("double")).alias("level_db"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged segments: the lines of an order are the segments of a video.

    Lines are dealt by video once, after the join with their part and into parts of about ``SEGMENT_ROWS``, so numbering them and all that is
    grouped by video later needs no other shuffle, and a task's memory doesn't grow with the table.
    """
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "video_no")
    rows = lines.count()  # answered from the parquet footers
    parts = max(spark.sparkContext.defaultParallelism, -(-rows // SEGMENT_ROWS))
    li = lines.select("video_no", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")]
    placed = ordered_scan(
        li.join(part, li.l_partkey == part.p_partkey).repartition(parts, "video_no"),
        ["video_no"],
        order,
        F.struct("l_linenumber", F.floor(F.col("l_partkey") / 4096).alias("part_range")),
        [Ordered("seg_no", "row_number"), Ordered("end_sec", "sum", F.col("l_quantity") * 4)],
        find_heavy(li, ["video_no"]),
    )
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("beginner", "intermediate", "advanced", "expert", "odd")]),
        (F.col("p_size") % 5 + 1).cast("int"),
    )
    return placed.select(
        "video_no",
        (F.col("seg_no") - 1).cast("int").alias("seg_index"),
        (F.col("end_sec") - F.col("l_quantity") * 4).alias("start_sec"),
        "end_sec",
        F.col("p_name").alias("topic"),
        F.when(F.col("p_size") % 11 == 0, "").otherwise(F.col("p_type")).alias("subject"),
        F.col("p_brand").alias("grade_level"),
        level.alias("difficulty"),
        F.split("p_name", " ").alias("tags"),
        ((F.col("l_quantity") % 17) / 16).alias("confidence"),
    )


def segment_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as the video rows of :func:`segments`."""
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    n = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        n.alias("video_no"),
        F.when(n % 19 == 0, "soft_deleted").when(n % 23 == 0, "failed").otherwise(status).alias("status"),
        F.when(n % 10 == 7, F.lit(None).cast("boolean")).otherwise(n % 3 != 0).alias("has_speech"),
        F.col("o_orderpriority").alias("language"),
        F.floor(epoch_micros(F.col("o_orderdate")) / 1_000_000).alias("created_s"),
        F.col("o_custkey").alias("owner_no"),
    )


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers per segment: clean, fenced, cut short, unclosed, prose (retried), text confidence."""
    s = segments(spark, sf_dir)
    kind = (F.col("video_no") + F.col("seg_index")) % 6
    q = F.lit('"')
    tag_list = F.concat(F.lit('["'), F.array_join("tags", '", "'), F.lit('"]'))
    head = F.concat(
        F.lit('{"topic": "'), F.col("topic"), F.lit('", "subject": "'), F.col("subject"),
        F.lit('", "grade_level": "'), F.col("grade_level"), F.lit('", "difficulty": "'), F.col("difficulty"),
        F.lit('", "mood": "calm", "tags": '), tag_list,
    )
    number = F.format_string("%.4f", "confidence")
    full = F.concat(head, F.lit(', "confidence": '), number, F.lit("}"))
    text_conf = F.concat(head, F.lit(', "confidence": '), q, number, q, F.lit("}"))
    first = (
        F.when(kind == 0, full)
        .when(kind == 1, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 2, F.concat(head, F.lit(', "confi')))
        .when(kind == 3, F.concat(head, F.lit(', "confidence": '), number))
        .when(kind == 4, F.concat(F.lit("I think this part is about "), F.col("topic")))
        .otherwise(text_conf)
    )
    second = F.when(
        (kind == 4) & (F.col("video_no") % 2 == 0), F.concat(head, F.lit("}"))
    ).otherwise(F.when(kind == 4, F.lit("Sorry, no answer.")))
    return s.select(
        "video_no", "seg_index", (F.col("video_no") % 3 == 0).alias("is_silent"),
        first.alias("raw_1"), second.alias("raw_2"),
    )


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job progress events: one job per user."""
    stages = F.create_map(*[F.lit(x) for kv in STAGE_OF_EVENT.items() for x in kv])
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_no"),
        (F.col("user_id") % 50).alias("video_no"),
        "event_id",
        epoch_micros(F.col("ts")).alias("us"),
        F.when((F.col("event_type") == "click") & (n % 4 == 0), "enqueue").otherwise(stages[F.col("event_type")]).alias("stage"),
        F.col("value").alias("seconds"),
        F.when(
            F.col("event_type") == "error",
            F.when(n % 13 == 0, F.array(F.lit("RuntimeError"), F.lit("ConnectionResetError")))
            .when(n % 13 == 1, F.array(F.lit("ReadTimeout")))
            .when(n % 13 == 2, F.array(F.lit("SoftTimeLimitExceeded")))
            .otherwise(F.array(F.lit("ValueError"))),
        ).alias("error_chain"),
        (n % 7).alias("retries"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searchable segments: one per document, with a vector."""
    emb = table(spark, sf_dir, "embeddings")
    size = emb.count()  # answered from the parquet footers
    docs = texts(spark, sf_dir).withColumn("vec_id", F.col("doc_id") % F.lit(size))
    return docs.join(emb, "vec_id").select(
        F.col("doc_id").alias("video_no"),
        F.lit(0).alias("seg_index"),
        F.when(F.col("doc_id") % 20 == 1, "soft_deleted").otherwise("done").alias("status"),
        F.col("source").alias("subject"),
        F.col("lang").alias("grade_level"),
        (F.col("doc_id") % 3 != 0).alias("has_speech"),
        F.lit(0.0).alias("start_sec"),
        (F.char_length("text") / 16).alias("end_sec"),
        F.substring("text", 1, 20).alias("topic"),
        F.substring("text", 1, 60).alias("summary"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".mp4")).alias("source_name"),
        F.col("text").alias("transcript_text"),
        "embedding",
    )


INDEXES: dict[tuple, str] = {}


def search_index(spark: SparkSession, sf_dir: str) -> str:
    """The stored postings of the corpus, built by the first search of a session over these files."""
    key = (spark.sparkContext.applicationId, *sorted(table(spark, sf_dir, "documents").inputFiles()))
    if key not in INDEXES:
        segments = with_tokens(corpus(spark, sf_dir).drop("embedding"))
        INDEXES[key] = build_index(segments, new_table_path(spark, "postings"))
    return INDEXES[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment vectors alone, one per row of the embeddings table."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("video_no"),
        F.lit(0).alias("seg_index"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("subject"),
        F.when(F.col("vec_id") % 20 == 1, "soft_deleted").otherwise("done").alias("status"),
        (F.col("vec_id") % 3 != 0).alias("has_speech"),
        "embedding",
    )


def vector_codes(spark: SparkSession, sf_dir: str) -> str:
    """The stored codes of the vectors, made by the first search of a session over these files."""
    key = (spark.sparkContext.applicationId, *sorted(table(spark, sf_dir, "embeddings").inputFiles()))
    if key not in INDEXES:
        INDEXES[key] = build_codes(vectors(spark, sf_dir), new_table_path(spark, "codes"))
    return INDEXES[key]


def window_vectors(spark: SparkSession, sf_dir: str, windows: DataFrame) -> DataFrame:
    """Give each transcript window the vector of one row of the embeddings table."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    size = emb.count()  # answered from the parquet footers
    keyed = windows.withColumn("vec_id", (F.col("video_no") * 31 + F.col("window_no")) % F.lit(size))
    return keyed.join(emb, "vec_id").drop("vec_id")


def frame_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-minute segments over the videos of :func:`frames`."""
    return (
        frame_videos(spark, sf_dir)
        .withColumn("seg_index", F.explode(F.sequence(F.lit(0), F.floor(F.col("duration_sec") / 240).cast("int"))))
        .select(
            "video_no",
            "seg_index",
            (F.col("seg_index") * 240.0).alias("start_sec"),
            F.least((F.col("seg_index") + 1) * 240.0, F.col("duration_sec")).alias("end_sec"),
            "is_silent",
        )
    )


def transcript_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute segments over the videos of :func:`transcript`."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_no"), F.explode(F.sequence(F.lit(0), F.floor(F.col("n_chars") / 960).cast("int"))).alias("seg_index")
    )
    return docs.select(
        "video_no", "seg_index", (F.col("seg_index") * 60.0).alias("start_sec"), ((F.col("seg_index") + 1) * 60.0).alias("end_sec")
    )


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label (6 decimals), numbered by label."""
    vectors = table(spark, sf_dir, "embeddings").select("label", array_to_vector("embedding").alias("v"))
    means = vectors.groupBy("label").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    return means.select(
        F.col("label").alias("label_no"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("label"),
        F.transform("m", lambda x: round_even(x, 6)).alias("vector"),
    )
