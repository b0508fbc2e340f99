"""Catalogue jobs: discovery, selection, exact de-duplication, registration, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelmill.functions.columns import basename, extension, safe_stem
from reelmill.schemas import ERROR_CHARS, REASON_DUPLICATE, REASON_EXISTS, REASON_NEW, VIDEO_EXTENSIONS


def with_known_extension(paths: DataFrame, exts: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Distinct paths whose extension, in any case, is a known one."""
    return (
        paths.select("source_path", extension(F.col("source_path")).alias("ext"))
        .where(F.col("ext").isin(list(exts)))
        .distinct()
    )


def select_by_spec(paths: DataFrame, spec: str | int | Sequence[str | int]) -> DataFrame:
    """Resolve a selection against the sorted paths.

    ``all``; ``first`` / ``one`` / ``single``; a 1-based position; an exact file name, else a substring; or a list or comma
    list of these. Each path comes back once, with the ordinal of the first item that chose it (``selector_no``).
    """
    paths = paths.select("source_path").distinct()
    if isinstance(spec, str) and "," in spec:
        spec = [x.strip() for x in spec.split(",") if x.strip()]
    items = list(spec) if isinstance(spec, (list, tuple)) else [spec]

    by_name = [str(x).strip().lower() for x in items]
    parts: list[DataFrame] = []
    names: list[tuple[int, str]] = []
    for i, item in enumerate(by_name):
        if item == "all":
            parts.append(paths.withColumn("selector_no", F.lit(i)))
        elif item.isdigit() or item in ("first", "one", "single"):
            k = int(item) if item.isdigit() else 1
            if k >= 1:
                nth = paths.orderBy("source_path").offset(k - 1).limit(1)
                parts.append(nth.withColumn("selector_no", F.lit(i)))
        else:
            names.append((i, item))
    if names:
        # one pass for every name: flag exact and substring hits, then keep substrings only for names without an exact hit
        lower = F.lower("source_path")
        hit = F.array(
            *[
                F.struct(
                    F.lit(i).alias("selector_no"),
                    (F.lower(basename(F.col("source_path"))) == n).alias("exact"),
                    lower.contains(n).alias("part"),
                )
                for i, n in names
            ]
        )
        hits = paths.select("source_path", F.inline(F.filter(hit, lambda h: h["exact"] | h["part"])))
        # at most one row per requested name
        exact = hits.where("exact").select("selector_no").distinct().withColumn("has_exact", F.lit(True))
        parts.append(
            hits.join(F.broadcast(exact), "selector_no", "left")
            .where(F.col("exact") | F.col("has_exact").isNull())
            .select("source_path", "selector_no")
        )
    if not parts:
        return paths.withColumn("selector_no", F.lit(0)).limit(0)
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    return chosen.groupBy("source_path").agg(F.min("selector_no").alias("selector_no"))


def skip_existing(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose id is not stored, whatever the stored status."""
    return incoming.join(stored.select("video_id"), "video_id", "left_anti")


def _usable_hash(h: Column) -> Column:
    return h.isNotNull() & (h != "")


def canonical_candidates(stored: DataFrame) -> DataFrame:
    """Per content hash the two earliest originals: enough to answer "earliest other than me" for any id.

    The rank filter is a group limit, so every input partition sends at most two rows per hash to the shuffle
    however many copies of one file there are.
    """
    originals = stored.where(
        _usable_hash(F.col("content_hash"))
        & ~F.coalesce(F.col("is_duplicate"), F.lit(False))
        & (F.col("status") != "soft_deleted")
    )
    earliest = Window.partitionBy("content_hash").orderBy("created_s", "video_id")
    return (
        originals.select("content_hash", "video_id", "created_s", F.row_number().over(earliest).alias("rn"))
        .where("rn <= 2")
        .groupBy("content_hash")
        .agg(
            F.min_by("video_id", "rn").alias("first_id"),
            F.max(F.when(F.col("rn") == 2, F.col("video_id"))).alias("second_id"),
        )
    )


def canonical_by_hash(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``canonical_video_id``: the earliest stored original with the same bytes and another id."""
    return (
        incoming.join(canonical_candidates(stored), "content_hash", "left")
        .withColumn(
            "canonical_video_id",
            F.when(F.col("first_id") != F.col("video_id"), F.col("first_id")).otherwise(F.col("second_id")),
        )
        .drop("first_id", "second_id")
    )


def exact_dedup(batch: DataFrame) -> DataFrame:
    """Mark byte-identical copies inside one batch; the earliest is the original of the rest.

    Only equal hashes match; nothing merges near copies. Copies are recorded as done and refer to the original.
    """
    firsts = (
        batch.where(_usable_hash(F.col("content_hash")))
        .groupBy("content_hash")
        .agg(F.min(F.struct("created_s", "video_id")).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")  # only repeated contents need the join
        .select("content_hash", F.col("first.video_id").alias("first_id"))
    )
    is_copy = F.col("first_id").isNotNull() & (F.col("first_id") != F.col("video_id"))
    return (
        batch.drop("is_duplicate")
        .join(firsts, "content_hash", "left")
        .withColumns(
            {
                "is_duplicate": is_copy,
                "canonical_video_id": F.when(is_copy, F.col("first_id")),
                "status": F.when(is_copy, F.lit("done")).otherwise(F.col("status")),
            }
        )
        .drop("first_id")
    )


def register_verdict(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Decide exists / duplicate / queued for every incoming item, with the reason text."""
    known = stored.select(
        "video_id", F.col("status").alias("old_status"), F.coalesce("is_duplicate", F.lit(False)).alias("old_dup")
    )
    exists = (F.col("old_status") == "done") & ~F.col("old_dup") & F.lit(not force)
    return (
        canonical_by_hash(incoming.select("video_id", "source_path", "content_hash", "file_size_bytes"), stored)
        .join(known, "video_id", "left")
        .select(
            "video_id",
            "source_path",
            "content_hash",
            "file_size_bytes",
            F.when(exists, "exists")
            .when(F.col("canonical_video_id").isNotNull(), "duplicate")
            .otherwise("queued")
            .alias("verdict"),
            F.when(F.coalesce(exists, F.lit(False)), F.lit(None)).otherwise(F.col("canonical_video_id")).alias("canonical_video_id"),
        )
        .withColumn(
            "reason",
            F.when(F.col("verdict") == "exists", REASON_EXISTS)
            .when(F.col("verdict") == "duplicate", REASON_DUPLICATE)
            .otherwise(REASON_NEW),
        )
    )


def register_arrivals(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalogue rows to write for a batch of arrivals, as if they had come one at a time.

    Items that are stored as done originals are left alone, before copies are looked for. A content that has a stored original keeps
    it: the original itself is queued again, all others are its copies. Of a content new to the store the earliest arrival is the
    original. No item ever refers to itself.
    """
    latest = batch.groupBy("video_id").agg(F.min_by(F.struct(*batch.columns), "created_s").alias("r")).select("r.*")
    settled = stored.where((F.col("status") == "done") & ~F.coalesce("is_duplicate", F.lit(False))).select("video_id")
    roots = canonical_candidates(stored).select("content_hash", "first_id")
    rows = latest.join(settled, "video_id", "left_anti").join(roots, "content_hash", "left").withColumn("status", F.lit("queued"))
    is_copy = F.col("first_id") != F.col("video_id")
    known = rows.where("first_id is not null").select(
        "video_id", "source_path", "content_hash", "file_size_bytes",
        F.when(is_copy, "done").otherwise("queued").alias("status"),
        is_copy.alias("is_duplicate"),
        F.when(is_copy, F.col("first_id")).alias("canonical_video_id"),
        "created_s",
    )
    new = exact_dedup(rows.where("first_id is null").drop("first_id"))
    return known.unionByName(new.select(*known.columns))


def register_batch(incoming: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """Bulk form: done items are skipped (duplicates included), the rest queued; contents are not compared."""
    known = stored.select("video_id", F.col("status").alias("old_status"), F.col("is_duplicate").alias("old_dup"))
    exists = F.coalesce((F.col("old_status") == "done") & F.lit(not force), F.lit(False))
    return incoming.join(known, "video_id", "left").select(
        "video_id",
        "source_path",
        F.when(exists, "exists").otherwise("queued").alias("verdict"),
        F.when(exists, F.coalesce(F.col("old_dup"), F.lit(False))).otherwise(F.lit(False)).alias("is_duplicate"),
    )


def register_batch_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count_if(F.col("verdict") == "queued").alias("enqueued"),
        F.lit(0).cast("long").alias("duplicates"),
        F.count_if(F.col("verdict") == "exists").alias("skipped_existing"),
        F.count(F.lit(1)).alias("total"),
    )


def upsert_latest(old: DataFrame, new: DataFrame, key: str = "video_id", keep: Sequence[str] = ("created_s",)) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` field by field; columns in ``keep`` stay with the old row.

    Both sides are unique on ``key``: one full outer join, one shuffle of each side.
    """
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    is_new = F.col("n._new").isNotNull()
    cols = []
    for c in old.columns:
        if c == key:
            cols.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c in keep:
            cols.append(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer").select(*cols)


def replace_children(old: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """Drop every old child of a re-processed parent, then add the new children."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new)


def soft_delete(videos: DataFrame, ids: DataFrame) -> DataFrame:
    """Flag the listed items as deleted; their rows stay."""
    gone = ids.select("video_id").distinct().withColumn("_gone", F.lit(True))
    return (
        videos.join(gone, "video_id", "left")
        .withColumn("status", F.when(F.col("_gone"), "soft_deleted").otherwise(F.col("status")))
        .select(*videos.columns)
    )


def apply_failures(videos: DataFrame, failures: DataFrame) -> DataFrame:
    """Mark items as failed with their message, cut to the stored length; of several messages of one item the last in order."""
    msgs = failures.groupBy("video_id").agg(F.max(F.substring("message", 1, ERROR_CHARS)).alias("_msg"))
    return (
        videos.join(msgs, "video_id", "left")
        .withColumn("error_message", F.coalesce(F.col("_msg"), F.col("error_message")))
        .withColumn("status", F.when(F.col("_msg").isNotNull(), "failed").otherwise(F.col("status")))
        .select(*videos.columns)
    )


def change_feed(before: DataFrame, after: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows (``key``, ``change``) of what became of each item between two states of a table: ``insert``, ``update`` or ``delete``.

    Rows are compared by a digest of all their columns, so only keys and digests are shuffled. Both states are unique on ``key``.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(c for c in before.columns if c != key)), {"ignoreNullFields": "false"}), 256)
    old, new = before.select(key, digest.alias("_old")), after.select(key, digest.alias("_new"))
    change = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete").otherwise("update")
    return old.join(new, key, "full_outer").where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, change.alias("change"))


def document_names(videos: DataFrame) -> DataFrame:
    """Output stem per item, with how many items share it (a shared stem means overwriting)."""
    named = videos.select("video_id", "source_path", safe_stem(F.col("source_path"), F.col("video_id")).alias("stem"))
    shared = named.groupBy("stem").agg(F.count(F.lit(1)).alias("n_same_stem"))
    return named.join(shared, "stem")
