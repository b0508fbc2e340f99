"""Reliable materialisation of an intermediate result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, set as its checkpoint folder. Only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(folder)
    return (spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the shared folder of the session, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A folder for a table that later steps of the session read."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
