"""Arrivals as a stream: register, de-duplicate, mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamReader, StreamingQuery
from pyspark.sql.types import StructType

from reelmill.sources.catalog import Catalogue


def read_manifests(
    spark: SparkSession, folder: str, schema: StructType | str, max_files: int = 1000, fmt: str = "json"
) -> DataFrame:
    """Manifest rows of files that land in an inbox folder."""
    reader: DataStreamReader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def register_into(catalogue: Catalogue):
    """Batch function: judge one micro-batch against the stored catalogue and upsert the result.

    A batch that was written to the end is left out when it comes again; one that wasn't ends in the same rows.
    """
    return catalogue.register


def start_register(
    manifests: DataFrame, catalogue: Catalogue, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Run :func:`register_into` on every micro-batch; without ``every`` all waiting files are processed, then it stops."""
    writer = manifests.writeStream.foreachBatch(register_into(catalogue)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def first_arrivals(arrivals: DataFrame, event_time: str = "arrived_at", delay: str = "1 hour") -> DataFrame:
    """First arrival of each content within the watermark delay; bounded state.

    Older history is not kept here: the stored table answers for it in :func:`register_into`.
    """
    return arrivals.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["content_hash"])
