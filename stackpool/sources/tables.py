"""Stored splits, records, features, named datasets and all writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackpool import schemas
from stackpool.functions.scores import format_score

_DATASETS: dict[str, Callable[[SparkSession, str, str], DataFrame]] = {}


# --- readers --------------------------------------------------------------------

def read_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """One split of a stored dataset; the others are pruned by folder."""
    if split not in schemas.SPLITS:
        raise ValueError(f"split must be one of {' '.join(schemas.SPLITS)}, got {split!r}")
    return spark.read.parquet(folder).filter(F.col("split") == split)


def read_items(df: DataFrame, items: list[str], defaults: dict = schemas.RECORD_DEFAULTS) -> DataFrame:
    """Only the asked fields, absent ones by their default; other columns are never read."""
    def item(name):
        value = F.col(name) if name in df.columns else F.lit(None)
        return (F.coalesce(value, F.lit(defaults[name])) if name in defaults else value).alias(name)
    return df.select(*[item(i) for i in items])


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows checked against the stored row count and width; a difference fails the query."""
    rows = spark.read.schema(schemas.FEATURES).parquet(f"{path}/rows")
    header = spark.read.parquet(f"{path}/header").first()
    n = rows.count()
    if n != header["num_samples"]:
        raise ValueError(f"{path}: {n} rows, header says {header['num_samples']}")
    width = header["feature_size"]
    return rows.withColumn("features", F.when(F.size("features") != width, F.raise_error(F.concat(
        F.lit(f"feature width is not {width} for "), F.col("id")))).otherwise(F.col("features")))


def register_dataset(name: str, reader: Callable[[SparkSession, str, str], DataFrame]) -> None:
    _DATASETS[name] = reader


def get_dataset(spark: SparkSession, name: str, split: str, folder: str) -> DataFrame:
    if name not in _DATASETS:
        raise ValueError(f"dataset must be one of {' '.join(sorted(_DATASETS))}, got {name!r}")
    return _DATASETS[name](spark, folder, split)


register_dataset("skin_lesions", lambda spark, folder, split: read_split(spark, folder, split))


# --- writers --------------------------------------------------------------------

def exists(spark: SparkSession, path: str) -> bool:
    """Whether a written table is complete at ``path``: its writer left ``_SUCCESS`` (any Hadoop file system)."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def write_once(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Build and write a table only if it is not there whole; the work is skipped, not just the write.

    What an unfinished run left is written over.
    """
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_shards(rows: DataFrame, folder: str, mode: str = "errorifexists", placed: bool = False) -> None:
    """Parquet with a folder for each split and the shard number as a column.

    Each shard is written by one task, rows in shard order, and a file holds
    whole shards, so folders and files do not grow with the number of shards.
    ``placed`` says that the rows already lie that way and need no shuffle.
    """
    if not placed:
        rows = rows.repartition("split", "shard").sortWithinPartitions("split", "shard", "pos")
    rows.write.mode(mode).partitionBy("split").parquet(folder)


def write_split_logs(rows: DataFrame, folder: str, key: str = "image", mode: str = "errorifexists") -> None:
    """Image ids per split, one per line."""
    rows.select("split", F.col(key).alias("value")).write.mode(mode).partitionBy("split").text(folder)


def write_sizes(counts: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Class or split sizes as JSON lines."""
    counts.coalesce(1).write.mode(mode).json(folder)


def score_text(pooled: DataFrame, probabilities: str = "probabilities", names=schemas.CLASS_NAMES) -> DataFrame:
    """Prediction rows as text columns: id, truth, one score per class, prediction."""
    return pooled.select("image", F.col("truth").cast("string").alias("truth"),
                         *[format_score(F.col(probabilities)[i]).alias(f"{n}[{i}]") for i, n in enumerate(names)],
                         F.col("prediction").cast("string").alias("prediction"))


def write_scores(pooled: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    score_text(pooled).write.mode(mode).option("header", True).option("quote", "").csv(folder)


def write_row_count(spark: SparkSession, folder: str, target: str, mode: str = "errorifexists") -> None:
    """Number of rows of a written text with header, as a one-row table beside it."""
    rows = spark.read.option("header", True).csv(folder)
    rows.agg(F.count(F.lit(1)).alias("num_samples")).write.mode(mode).json(target)


def write_metadata_summary(rows: DataFrame, columns: list[str], folder: str, mode: str = "errorifexists") -> None:
    """Per column of a metadata table: its name, how many values there are and how many differ, as JSON lines."""
    counts = rows.agg(*[F.count(c).alias(f"n_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    each = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("values"), F.col(f"d_{c}").alias("distinct_values")) for c in columns]
    counts.select(F.explode(F.array(*each)).alias("s")).select("s.*").write.mode(mode).json(folder)


def feature_text(rows: DataFrame, width: int) -> DataFrame:
    """Feature rows as text columns: id, truth, one column per feature."""
    return rows.select("id", F.col("label").cast("string").alias("truth"),
                       *[format_score(F.col("features")[i]).alias(f"feature[{i}]") for i in range(width)])


def write_features(rows: DataFrame, folder: str, feature_size: int, options: dict | None = None) -> None:
    """Feature rows as Parquet, and beside them a one-row header: row count, width, options."""
    rows.select("id", F.col("label").cast("int").alias("label"), "features").write.parquet(f"{folder}/rows")
    spark = rows.sparkSession
    (spark.read.parquet(f"{folder}/rows").agg(F.count(F.lit(1)).alias("num_samples"))
     .withColumn("feature_size", F.lit(feature_size)).withColumn("options", F.lit(str(options or {})))
     .write.parquet(f"{folder}/header"))


def write_ordered(rows: DataFrame, folder: str, order: list[str]) -> None:
    """Rows in the order of the columns ``order``: sorted files that follow each other, and beside them which file is which.

    One range shuffle.  ``files`` has file_no, name, rows and start (rows in the
    files before), a row for each file.
    """
    rows.orderBy(*order).write.parquet(f"{folder}/rows")
    spark = rows.sparkSession
    name = F.col("_metadata.file_name")
    written = spark.read.parquet(f"{folder}/rows").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    # a task's number, then that of its files; one row a file
    number = [F.regexp_extract("name", pattern, 1).cast("long") for pattern in (r"^part-(\d+)", r"c(\d+)\.[^/]*$")]
    by_file = Window.orderBy("_part", "_piece")
    numbered = written.withColumns({"_part": number[0], "_piece": number[1]})
    (numbered.select((F.row_number().over(by_file) - 1).alias("file_no"), "name", "rows",
                     F.coalesce(F.sum("rows").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
     .write.parquet(f"{folder}/files"))


def read_ordered(spark: SparkSession, folder: str, position: str = "position") -> DataFrame:
    """Rows that ``write_ordered`` wrote, each with its place in the order; nothing is sorted or shuffled."""
    rows = spark.read.parquet(f"{folder}/rows")
    placed = rows.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
    starts = spark.read.parquet(f"{folder}/files").select(F.col("name").alias("_name"), F.col("start").alias("_start"))
    # bounded: one row per written file
    return placed.join(F.broadcast(starts), "_name").withColumn(position, F.col("_start") + F.col("_row")).drop("_name", "_row", "_start")


def write_submission(rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Headerless id, p_m, p_k lines."""
    rows.select("image", "p_m", "p_k").write.mode(mode).option("header", False).csv(folder)


def write_metadata_text(rows: DataFrame, folder: str, columns: list[str], mode: str = "errorifexists") -> None:
    """Metadata text with the word None for absent values."""
    from stackpool.operators.normalise import null_to_none
    null_to_none(rows, columns).write.mode(mode).option("header", True).csv(folder)


def run_log(spark: SparkSession, options: dict, started, finished) -> DataFrame:
    """One row describing a run: its options, start, finish and elapsed seconds (UTC)."""
    row = (sorted((str(k), str(v)) for k, v in options.items()), started, finished, (finished - started).total_seconds())
    return spark.createDataFrame([(dict(row[0]), *row[1:])],
                                 "options map<string,string>, started timestamp, finished timestamp, elapsed_seconds double")
