"""Stratified, case-grouped, leakage-checked splitting and sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.functions.draws import shuffle_key
from stackpool.operators.order import global_index
from stackpool.operators.skew import ROWS_PER_TASK, lookup_join
from stackpool.session import materialise

# Fixed values.
SEED = 0
TRAIN_PERCENT = 85
VALIDATION_PERCENT = 15
ROWS_PER_SHARD = 1024
FILE_PREFIX = "skin_lesions"


def strata(meta: DataFrame) -> DataFrame:
    """One row per stratum a row belongs to; one that is both goes to both."""
    mel, ker = F.col("melanoma").cast("string") == "1", F.col("keratosis").cast("string") == "1"
    names = F.array_compact(F.array(F.when(mel, "melanoma"), F.when(ker, "keratosis"), F.when(~mel & ~ker, "other")))
    return meta.withColumn("stratum", F.explode(names))


def class_counts(meta: DataFrame) -> DataFrame:
    return strata(meta).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))


def split_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _positions(rows: DataFrame, group: str, order: list, name: str, tag: str) -> DataFrame:
    """Dense position inside each of a few groups, and the group's size as ``_n``.

    One global range sort serves all groups, so a group of any size is spread.
    """
    indexed = global_index(rows, [group, *order], "_idx", tag)
    # one row per stratum or split
    sizes = indexed.groupBy(group).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_n"))
    return (indexed.join(F.broadcast(sizes), group)
            .withColumn(name, F.col("_idx") - F.col("_first")).drop("_idx", "_first"))


def split_dataset(meta: DataFrame, seed: int = SEED, train: int = TRAIN_PERCENT, validation: int = VALIDATION_PERCENT,
                  rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Assign every row of ``meta`` (image, case_id, melanoma, keratosis, line_no, ...) to a split.

    Per stratum, the first row of a case and all rows without a case are
    shuffled and cut by percentage.  The other rows of a case follow a
    representative of that case: test before validation before train.
    ``line_no`` must be distinct; a repeated one raises ValueError.
    """
    if train + validation > 100 or min(train, validation) < 0:
        raise ValueError("train and validation percentages must be within 0..100 together")
    rows = strata(meta)
    has_case = F.length(F.coalesce("case_id", F.lit(""))) > 0
    firsts = (rows.filter(has_case).groupBy("stratum", "case_id").agg(F.min("line_no").alias("line_no"))
              .withColumn("_first_of_case", F.lit(True)))
    flagged = (rows.join(firsts, ["stratum", "case_id", "line_no"], "left")
               .withColumn("_rep", ~has_case | F.coalesce("_first_of_case", F.lit(False))).drop("_first_of_case"))
    # metadata only; read by the representatives, the rest, and the count of frequent cases
    flagged = materialise(flagged, "strata")
    require_unique(flagged, ["stratum", "line_no"])

    reps = flagged.filter("_rep").drop("_rep")
    placed = _positions(reps, "stratum", [shuffle_key(seed, "image"), "line_no"], "_rank", "split")
    n = F.col("_n").cast("double") / 100.0
    n_train, n_validation = F.floor(n * train), F.floor(n * validation)
    placed = placed.withColumn("split", F.when(F.col("_rank") < n_train, "train")
                               .when(F.col("_rank") < n_train + n_validation, "validation")
                               .otherwise("test")).drop("_rank", "_n")

    priority = F.when(F.col("split") == "test", 2).when(F.col("split") == "validation", 1).otherwise(0)
    case_split = (placed.filter(has_case).groupBy("case_id").agg(F.max(priority).alias("_p"))
                  .select("case_id", F.element_at(F.array(*map(F.lit, ("train", "validation", "test"))),
                                                  F.col("_p") + 1).alias("split")))
    extras = flagged.filter("not _rep").drop("_rep")
    extras = lookup_join(extras, case_split, "case_id", "line_no", "inner", rows_per_task)
    return placed.unionByName(extras)


def contaminated(rows: DataFrame, key: str) -> DataFrame:
    """Keys found in more than one split ('' is no key)."""
    return (rows.filter(F.length(F.col(key).cast("string")) > 0).groupBy(key)
            .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
            .filter(F.col("first_split") != F.col("last_split")))


def require_unique(rows: DataFrame, keys: list[str]) -> None:
    """Fail if a key repeats; only the keys are read."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").take(1)
    if found:
        raise ValueError(f"{' and '.join(keys)} repeat, e.g. {found[0].asDict()}")


def require_disjoint(rows: DataFrame, key: str = "image") -> None:
    """Fail before anything is written if an image is in two splits."""
    found = contaminated(rows, key).take(5)
    if found:
        raise ValueError(f"cross contamination among splits, e.g. {[r[key] for r in found]}")


def shuffle(rows: DataFrame, seed: int, key: str = "image") -> DataFrame:
    """Dense position of each row in a seeded shuffle."""
    return global_index(rows, [shuffle_key(seed, key), key], "pos", "shuffle")


def assign_shards(rows: DataFrame, order: list, group: str = "split", per_shard: int = ROWS_PER_SHARD,
                  prefix: str = FILE_PREFIX) -> DataFrame:
    """Shard number and file name by position inside each split.

    Shards hold ``per_shard`` rows.  If the rest is under a third of that, the
    last shard is dropped (one always stays) and the one before takes the rest.
    """
    placed = _positions(rows, group, order, "pos", "shards")
    n, per = F.col("_n"), F.lit(per_shard)
    full = F.ceil(n / per)
    shards = F.when(n % per < int(per_shard / 3.0), F.greatest(full - 1, F.lit(1))).otherwise(full)
    shard = F.least(F.floor(F.col("pos") / per), shards - 1)
    return (placed.withColumn("num_shards", shards.cast("int")).withColumn("shard", shard.cast("int"))
            .withColumn("file", F.format_string("%s_%s_%05d-of-%05d", F.lit(prefix), F.col(group),
                                                F.col("shard") + 1, F.col("num_shards")))
            .drop("_n"))
