"""The stored catalogue: videos in buckets of their id, and a narrow copy in buckets of their content.

A batch reads and rewrites the buckets of its own ids, and those of the contents it brings or takes away; the rest of the history isn't opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.materialize import materialize
from reelmill.operators.catalog import register_arrivals, upsert_latest
from reelmill.sources.buckets import BucketedTable

CONTENT = ["content_hash", "video_id", "created_s", "status", "is_duplicate"]


class Catalogue:
    """Videos (at least the columns of ``CONTENT``) under one folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, buckets: int = 256):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.videos = BucketedTable.of(spark, f"{self.folder}/videos", schema, "video_id", buckets)
        narrow = self.videos.read([]).select(*CONTENT).schema
        self.contents = BucketedTable.of(spark, f"{self.folder}/contents", narrow, "content_hash", buckets)

    def read(self) -> DataFrame:
        return self.videos.read()

    def done(self, batch_id: int) -> bool:
        """Whether a batch has been written to the end."""
        return bool(self._batches().where(F.col("batch_id") == batch_id).limit(1).count())

    def _batches(self) -> DataFrame:
        self.spark.createDataFrame([], "batch_id long, buckets array<int>").write.mode("append").parquet(f"{self.folder}/batches")
        return self.spark.read.schema("batch_id long, buckets array<int>").parquet(f"{self.folder}/batches")

    def touched(self, batch_id: int) -> list[int]:
        """Buckets of videos that a batch rewrote."""
        return sorted(b for r in self._batches().where(F.col("batch_id") == batch_id).collect() for b in r["buckets"])

    def register(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Judge arrivals (:func:`register_arrivals`) and store the outcome. A batch id that is done already changes nothing."""
        if batch_id is not None and self.done(batch_id):
            return
        batch = materialize(batch)
        known = self.videos.read(self.videos.buckets_of(batch)).select(*CONTENT)
        same = self.contents.read(self.contents.buckets_of(batch))
        stored = known.unionByName(same).dropDuplicates(["video_id"])
        self.upsert(register_arrivals(batch, stored), batch_id)

    def upsert(self, rows: DataFrame, batch_id: int | None = None) -> None:
        """Replace or add videos (:func:`upsert_latest`). Running it again after a failure ends in the same state."""
        rows = materialize(rows)
        buckets = self.videos.buckets_of(rows)
        old = self.videos.read(buckets)
        after = materialize(upsert_latest(old, rows.select(*old.columns)))
        # contents of the rows as they were and as they are; each bucket loses the old entries of these videos and gets the new ones
        ids = rows.select("video_id").distinct()
        named = F.col("content_hash") != ""  # a missing or empty content matches nothing, so it has no entry
        now, before = (x.join(ids, "video_id", "left_semi").select(*CONTENT).where(named) for x in (after, old))
        of_content = self.contents.buckets_of(materialize(now.unionByName(before)))
        kept = self.contents.read(of_content).join(ids, "video_id", "left_anti")
        # a bucket that loses all its entries is still rewritten, by an entry of no video
        empty = before.select("content_hash").distinct().select("content_hash", *[F.lit(None).cast(self.contents.schema[c].dataType).alias(c) for c in CONTENT[1:]])
        contents = materialize(kept.where("video_id IS NOT NULL").unionByName(now).unionByName(empty))
        self.videos.write(after)
        self.contents.write(contents)
        if batch_id is not None:
            done = self.spark.createDataFrame([(batch_id, buckets)], "batch_id long, buckets array<int>")
            done.coalesce(1).write.mode("append").parquet(f"{self.folder}/batches")
