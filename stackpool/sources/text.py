"""Delimited, line and JSON readers with declared columns and line numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackpool import schemas
from stackpool.session import materialise_each


def _number_lines(df: DataFrame, name: str) -> DataFrame:
    """0-based line number within each file, without moving the rows.

    Rows keep their order inside a file block, and the running row id grows in
    that order, so (file, block start, row id) is file order.  Only one count
    per block is shuffled.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_start"),
                       F.monotonically_increasing_id().alias("_row"))
    blocks = tagged.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_start", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return (tagged.join(offsets, ["_file", "_start"])
            .withColumn(name, F.col("_base") + F.col("_row") - F.col("_first"))
            .drop("_file", "_start", "_row", "_first", "_base"))


def _blank_nulls(df: DataFrame) -> DataFrame:
    """An empty text field reads as ''."""
    return df.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in df.schema
                           if isinstance(f.dataType, T.StringType)})


def scan_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", header: bool = True,
                   line_no: str | None = None) -> DataFrame:
    """Positional columns with surrounding blanks trimmed; the header names are not used."""
    raw = (spark.read.schema(schema).option("sep", sep).option("header", header).option("enforceSchema", True)
           .option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
           .option("quote", "").csv(path))
    return _blank_nulls(_number_lines(raw, line_no) if line_no else raw)


def scan_metadata(spark: SparkSession, path: str, line_no: str | None = None) -> DataFrame:
    return scan_delimited(spark, path, schemas.METADATA, line_no=line_no)


def scan_tsv(spark: SparkSession, path: str, schema: T.StructType, line_no: str | None = None) -> DataFrame:
    return scan_delimited(spark, path, schema, sep="\t", line_no=line_no)


def scan_predictions(spark: SparkSession, path: str, line_no: str | None = None) -> DataFrame:
    return scan_delimited(spark, path, schemas.PREDICTIONS, header=False, line_no=line_no)


def scan_truth(spark: SparkSession, path: str, line_no: str | None = None) -> DataFrame:
    """Truth file; labels such as '1.0' become whole numbers."""
    raw = scan_delimited(spark, path, schemas.TRUTH_TEXT, line_no=line_no)
    return raw.withColumns({c: F.col(c).cast("double").cast("int") for c in ("melanoma", "keratosis")})


def scan_keys(spark: SparkSession, path: str, name: str = "image") -> DataFrame:
    """One trimmed key per line; a blank line is the key ''."""
    return spark.read.text(path).select(F.trim("value").alias(name))


def scan_key_values(spark: SparkSession, path: str) -> DataFrame:
    """Near-duplicate map; the last line of a key wins."""
    rows = scan_delimited(spark, path, schemas.NEAR_DUPLICATES, header=False, line_no="line_no")
    return rows.groupBy("image").agg(F.max_by("case_id", "line_no").alias("case_id"))


def scan_clinical(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON document per file; the id is the file name up to its first dot.

    Of several folders the driver holds the listings of a few at a time.
    """
    if not isinstance(path, str):
        return materialise_each(spark, path, scan_clinical, "clinical")
    raw = spark.read.schema(schemas.CLINICAL).option("multiLine", True).json(path)
    return raw.select(F.substring_index(F.col("_metadata.file_name"), ".", 1).alias("image"),
                      *[F.col(f"meta.clinical.{f}").alias(f) for f in schemas.CLINICAL_FIELDS])


def scan_components(spark: SparkSession, folder: str, glob: str = "partial_*",
                    pattern: str = r"partial_(.+)_([123])\.txt") -> DataFrame:
    """All component files in one read; set and replica come from the file name.

    ``bad_width`` marks a line that has not exactly three fields.
    """
    name = F.col("_metadata.file_path")
    lines = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(folder)
    parts = F.split("value", ",")
    return lines.select(F.regexp_extract(name, pattern, 1).alias("set_name"),
                        F.regexp_extract(name, pattern, 2).cast("int").alias("replica"),
                        F.trim(parts[0]).alias("image"),
                        F.try_element_at(parts, F.lit(2)).try_cast("double").alias("p_m"),
                        F.try_element_at(parts, F.lit(3)).try_cast("double").alias("p_k"),
                        (F.size(parts) != 3).alias("bad_width"))


def drop_masks(listing: DataFrame, path: str = "path", word: str = "mask|superpixel") -> DataFrame:
    """Listing without mask and superpixel pictures."""
    return listing.filter(~F.col(path).rlike(word))
