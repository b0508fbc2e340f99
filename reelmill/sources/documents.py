"""Result documents as JSON files, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelmill.functions.columns import safe_stem

COMBINED = "all_results.json"


def latest_by_stem(docs: DataFrame) -> DataFrame:
    """``docs`` with their safe stem; of documents that share one, the one with the largest video id."""
    named = docs.withColumn("stem", safe_stem(F.col("source_path"), F.col("video_id")))
    # the aggregate carries ids only; the documents follow by an equality join
    winners = named.groupBy("stem").agg(F.max("video_id").alias("video_id"))
    return named.join(winners, ["stem", "video_id"], "left_semi")


def export_incremental(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Documents (with ``stem``) after an export: fresh ones replace those of the same stem, all others stay."""
    latest = latest_by_stem(fresh)
    return stored.join(latest.select("stem").distinct(), "stem", "left_anti").unionByName(latest.select(*stored.columns))


def write_documents(docs: DataFrame, folder: str) -> None:
    """One JSON file per document in ``folder/stem=<safe stem>``.

    Only the folders of the written stems are replaced; documents of other stems stay. Documents of one batch that share a stem
    overwrite one another: the one with the largest video id is kept.
    """
    (
        latest_by_stem(docs)
        .repartition("stem")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("stem")
        .json(folder)
    )


def read_documents(spark: SparkSession, folder: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """Exported documents again, leaving out a combined list file if one lies among them."""
    files = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).json(folder)
    return files.where(~F.input_file_name().endswith(COMBINED))
