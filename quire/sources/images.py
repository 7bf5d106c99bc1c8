"""Image files as rows, by batch or stream; files that aren't images go to dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under ``path`` as Spark's image source reads it: ``image`` (origin, height, width, nChannels, mode, data).

    Decoding is the JVM's (PNG, JPEG, GIF, BMP). Files that can't be decoded have height -1;
    files of no bytes give no row.
    """
    return spark.read.format("image").option("dropInvalid", "false").load(path)


def image_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same for files that come to be under ``path``."""
    schema = spark.read.format("image").load(path).schema  # of the source, the same for any files
    return spark.readStream.format("image").schema(schema).option("dropInvalid", "false").option("maxFilesPerTrigger", files_per_trigger).load(path)


def sorted_out(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name and image of images, name and error of other files); ``name`` is the file's name."""
    rows = files.select(F.element_at(F.split("image.origin", "/"), -1).alias("name"), "image")
    bad = F.col("image.height") < 0
    return rows.filter(~bad), rows.filter(bad).select("name", F.lit("not an image").alias("error"))


def foreground(files: DataFrame) -> DataFrame:
    """(name, pixels, page) of images: the box of dark pixels in pixels, and padded in page units; null for blank ones."""
    of = lambda pad: images.foreground_box(*(F.col(f"image.{c}") for c in ("height", "width", "nChannels", "data")), pad)
    return sorted_out(files)[0].select("name", of(False).alias("pixels"), of(True).alias("page"))
