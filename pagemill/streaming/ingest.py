"""Image files that arrive in a folder, as a stream of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig, ParsingMode
from ..functions import text as X
from ..operators.stage import run_stage


def stream_replies(replies: DataFrame, reply: str = "reply", at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Model replies as records, each content once: repeats within the watermark are dropped by their id."""
    texts = replies.withColumn("content", X.extract_or_empty(F.col(reply))).where("content <> ''")
    return texts.withColumn("id", X.content_id("content")).withWatermark(at, late).dropDuplicatesWithinWatermark(["id"])


def stream_images(spark: SparkSession, folder: str, decode, mode: ParsingMode, config: EngineConfig = EngineConfig(), transport=None, build_recognizer=None, files_per_trigger: int = 64) -> DataFrame:
    """New files of a folder through the fused stage. decode: a column expression from content to an image struct."""
    files = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).load(folder)
    images = files.select("path", decode(F.col("content")).alias("image"), F.lit(None).cast("string").alias("error"))
    return run_stage(images, mode, config, transport, build_recognizer)
