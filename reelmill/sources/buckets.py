"""Tables stored in hash buckets of a key, so that a change rewrites the buckets of its keys and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKET = "bucket"


@dataclass(frozen=True)
class BucketedTable:
    """Parquet under ``folder``, in one sub-folder for each of ``n`` hash values of ``key``. One writer at a time.

    Rows are replaced by whole buckets (dynamic partition overwrite): the new files of all buckets are complete before the first old one goes.
    """

    spark: SparkSession
    folder: str
    schema: StructType
    key: str
    n: int = 256

    @classmethod
    def of(cls, spark: SparkSession, folder: str, schema: StructType | str, key: str, n: int = 256) -> BucketedTable:
        kind = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        return cls(spark, folder.rstrip("/"), kind, key, n)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int").alias(BUCKET)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys in ``rows`` (``n`` numbers at most)."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: other folders aren't opened."""
        stored = StructType([*self.schema.fields, StructField(BUCKET, IntegerType())])
        path = f"{self.folder}/rows"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(stored).option("basePath", path).parquet(path)
        if buckets is not None:
            rows = rows.where(F.col(BUCKET).isin(buckets))
        return rows.select(*self.schema.fieldNames())

    def write(self, rows: DataFrame) -> None:
        """Put ``rows`` in place of all rows of the buckets they fall into; a bucket without rows stays as it is."""
        dealt = rows.select(*self.schema.fieldNames(), self.bucket())
        dealt.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.folder}/rows")
