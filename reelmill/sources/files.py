"""Media files as a table, and scan helpers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.functions.columns import extension, stable_uuid
from reelmill.schemas import VIDEO_EXTENSIONS


# Files up to this size fit into one row; larger ones are read in pieces.
WHOLE_BYTES = 256 << 20
PIECE_BYTES = 4 << 20


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that has fewer partitions than the session has cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _listing(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """Paths and sizes only: the content column is never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select(
        F.regexp_replace("path", "^file:(//)?", "").alias("source_path"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").alias("modified_at"),
    )


def discover_folder(spark: SparkSession, folder: str, exts: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Every file below a folder with a known extension, in any case."""
    return _listing(spark, folder, recursive=True).where(extension(F.col("source_path")).isin(list(exts)))


def discover_glob(spark: SparkSession, pattern: str, exts: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Files of a glob. A glob ending in a known extension stands for the same base with every known extension."""
    base, _, ext = pattern.rpartition(".")
    if base and ext.lower() in exts:
        pattern = base + ".{" + ",".join(exts) + "}"
    return _listing(spark, pattern, recursive=False)


def identify(spark: SparkSession, files: DataFrame, folder: str, exts: Sequence[str] = VIDEO_EXTENSIONS) -> DataFrame:
    """Add id and SHA-256 of the bytes to discovered files.

    Only files with a known extension are read. Files of up to ``WHOLE_BYTES`` are hashed inside the JVM, one row each; larger ones are read
    in pieces by the task that has their path. A file that can't be read has no hash and size 0.
    """
    any_case = ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts)
    whole = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{{{any_case}}}")
        .load(folder)
        .where(F.col("length") <= WHOLE_BYTES)
        .select(F.regexp_replace("path", "^file:(//)?", "").alias("source_path"), F.sha2("content", 256).alias("content_hash"))
    )
    large = files.where(F.col("file_size_bytes") > WHOLE_BYTES).select("source_path")
    hashed = whole.unionByName(large.mapInPandas(_hash_in_pieces, "source_path string, content_hash string"))
    found = files.join(hashed, "source_path", "left").withColumn("video_id", stable_uuid(F.col("source_path")))
    return found.withColumn("file_size_bytes", F.when(F.col("content_hash").isNull(), F.lit(0)).otherwise(F.col("file_size_bytes")))


def _hash_in_pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(content_hash=[_file_hash(p) for p in pdf["source_path"]])


def _file_hash(path: str) -> str | None:
    try:
        system, place = FileSystem.from_uri(path)
        digest = hashlib.sha256()
        with system.open_input_stream(place) as stream:
            while piece := stream.read(PIECE_BYTES):
                digest.update(piece)
        return digest.hexdigest()
    except (OSError, pa.ArrowException):
        return None
