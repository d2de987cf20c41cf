"""Image files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import IMAGE


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, image (BGR raster) and error; files that can't be decoded come with an error, the others survive."""
    raw = spark.read.format("image").load(path)
    bad = F.col("image.height") < 0
    return raw.select(
        F.col("image.origin").alias("path"),
        F.when(~bad, F.col("image")).alias("image"),
        F.when(bad, F.concat(F.lit("Could not load image: "), F.col("image.origin"))).alias("error"),
    )


def from_rasters(rasters: DataFrame) -> DataFrame:
    """Rasters that are there already (an `image` column as Spark's image source has it) pass as they are."""
    if rasters.schema["image"].dataType.fieldNames() != IMAGE.fieldNames():
        raise ValueError("the image column needs the fields " + ", ".join(IMAGE.fieldNames()))
    return rasters.select("path" if "path" in rasters.columns else F.col("image.origin").alias("path"), "image", F.lit(None).cast("string").alias("error"))
