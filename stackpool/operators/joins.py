"""Key checks between tables: existence, exclusion, completeness, positional zip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# No join here forces a broadcast: the lists are users' files of any length, and
# adaptive execution broadcasts a side once its real size is known to be small.


def one_per_key(df: DataFrame, key: str, values: list[str], line_no: str = "line_no") -> DataFrame:
    """One row per key: that of the last line, if lines are numbered.

    Without line numbers a key whose rows differ fails the query.
    """
    if line_no in df.columns:
        return df.groupBy(key).agg(*[F.max_by(v, line_no).alias(v) for v in values])
    differ = F.raise_error(F.concat(F.lit("differing rows for "), F.col(key).cast("string")))
    return df.groupBy(key).agg(*[F.when(F.min(v).eqNullSafe(F.max(v)), F.max(v)).otherwise(differ).alias(v) for v in values])


def with_case(df: DataFrame, near_duplicates: DataFrame) -> DataFrame:
    """Case of an image from the near-duplicate map, '' where it has none."""
    cases = one_per_key(near_duplicates, "image", ["case_id"]).withColumnRenamed("case_id", "_case")
    return (df.drop("case_id").join(cases, "image", "left")
            .withColumn("case_id", F.coalesce("_case", F.lit(""))).drop("_case"))


def mark_existing(df: DataFrame, listing: DataFrame, key: str = "image", name: str = "exists") -> DataFrame:
    """Flag rows whose key is listed; one join serves both the kept and the rejected rows."""
    marks = listing.select(key).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def keep_existing(df: DataFrame, listing: DataFrame, key: str = "image") -> DataFrame:
    return df.join(listing.select(key), key, "left_semi")


def missing(df: DataFrame, listing: DataFrame, key: str = "image") -> DataFrame:
    return df.join(listing.select(key), key, "left_anti")


def zip_by_line(left: DataFrame, right: DataFrame, left_key: str, right_key: str,
                line_no: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """Rows of two tables at the same position, split into (matching keys, differing keys).

    Positions past the end of the shorter table are left out.
    """
    both = left.join(right, line_no)
    same = F.col(left_key).eqNullSafe(F.col(right_key))
    return both.filter(same), both.filter(~same)


def join_truth(submission: DataFrame, truth: DataFrame, key: str = "image",
               labels: tuple[str, ...] = ("melanoma", "keratosis")) -> DataFrame:
    """Submission with its truth, of a repeated id the last line; the query fails on an image without truth."""
    joined = submission.join(one_per_key(truth, key, list(labels)), key, "left")
    gone = F.concat(F.lit("no truth for "), F.col(key).cast("string"))
    return joined.withColumns({c: F.when(F.col(c).isNull(), F.raise_error(gone)).otherwise(F.col(c)).cast("int")
                               for c in labels})

