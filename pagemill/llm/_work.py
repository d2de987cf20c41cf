"""Shared working folder, size estimates and driver-side limits of the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import shared_dir, ship

#: Bytes that may be sent to every executor or gathered on the driver; beyond it the operators take their shuffled paths.
SEND_LIMIT = 64 << 20


class Scratch:
    """Tables written once in the shared folder, so that no lineage before them is computed again."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path, partitionBy=partition_by)
        out = self.spark.read.schema(StructType([f for f in df.schema])).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a kept table that nothing reads any more."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate, which for a scan is the size of its files. Where it has none, the length of all texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    texts = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind == "string"]
    return int(df.agg(sum(texts, F.count("*") * 8)).first()[0])


def fragments(df: DataFrame, each: int, least: int = 4, most: int = 1 << 17) -> int:
    """How many parts of about `each` input bytes the table gives; it follows the input."""
    return max(least, min(most, -(-size_in_bytes(df) // each)))
