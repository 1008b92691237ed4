"""Equi-join of many rows to one row per key, safe when a key is very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def lookup_join(big: DataFrame, small: DataFrame, key: str, row_id: str, how: str = "left",
                rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Join ``big`` to ``small`` (at most one row per key), spreading frequent keys.

    Keys with more than ``rows_per_task`` rows are found by a map-side combined
    count.  There can be at most rows / rows_per_task of them, which bounds the
    broadcast.  Their rows get a salt, and only their small-side row is copied
    once per salt; all other keys join unsalted.  The salt is a hash of
    ``row_id`` (distinct per row), so a re-run task salts alike.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hot = (big.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
           .filter((F.col("_n") > rows_per_task) & F.col(key).isNotNull())
           .select(F.col(key), F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")))
    salted_big = (big.join(F.broadcast(hot), key, "left")
                  .withColumn("_salt", F.pmod(F.xxhash64(row_id), F.coalesce("_salts", F.lit(1))).cast("int"))
                  .drop("_salts"))
    salted_small = (small.join(F.broadcast(hot), key, "left")
                    .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
                    .drop("_salts"))
    return salted_big.join(salted_small, [key, "_salt"], how).drop("_salt")
