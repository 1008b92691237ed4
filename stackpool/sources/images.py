"""Picture files through Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackpool.operators.images import from_image_source
from stackpool.session import materialise_each


def scan_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pictures, rejects) of a folder; a file that cannot be decoded becomes a reject, not a failure."""
    return from_image_source(spark.read.format("image").option("dropInvalid", False).load(path))


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """Image ids that have a file; file contents are not read.

    Of several folders the driver holds the listings of a few at a time.
    """
    if not isinstance(path, str):
        return materialise_each(spark, path, lambda s, folder: list_files(s, folder, glob), "listed")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "").alias("image"))
