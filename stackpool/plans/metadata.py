"""Six raw sources into one training table, with every rejected row accounted for."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.operators import joins as J
from stackpool.operators import normalise as N
from stackpool.operators.order import global_index, numbered_with_previous, with_previous

# Order in which the sources are read; adjacent repeats are judged across it.
SOURCES = ("atlas", "archive", "challenge", "irma", "ph2", "dermofit")


def zip_challenge(meta: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Challenge metadata and truth side by side, and the rows whose ids differ."""
    return J.zip_by_line(meta, truth.withColumnRenamed("image", "truth_image"), "image", "truth_image")


def union_sources(raw: Mapping[str, DataFrame], mode: str, near_duplicates: DataFrame | None = None) -> DataFrame:
    """Normalised sources in reading order (``source_no``, ``line_no``)."""
    N.check_mode(mode)
    if mode == "DEPLOY" and near_duplicates is None:
        raise ValueError("mode DEPLOY needs the near-duplicate map")
    unknown = set(raw) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources {sorted(unknown)}")
    filters = {"archive": N.filter_archive, "irma": N.filter_irma, "ph2": N.filter_ph2} if mode != "ALL" else {}
    normal = {"atlas": N.norm_atlas, "archive": N.norm_archive, "challenge": N.norm_challenge,
              "irma": N.norm_irma, "ph2": N.norm_ph2, "dermofit": N.norm_dermofit}
    parts = []
    for number, name in enumerate(SOURCES):
        if name in raw:
            part = normal[name](filters.get(name, lambda d: d)(raw[name]))
            parts.append(part.withColumn("source_no", F.lit(number)))
    table = reduce(DataFrame.unionByName, parts)
    if mode != "DEPLOY":
        return table
    # one join serves all sources; the atlas keeps its own cases
    own = F.when(F.col("dataset") == "atlas", F.col("case_id"))
    cased = J.with_case(table.withColumn("_own", own), near_duplicates)
    return cased.withColumn("case_id", F.coalesce("_own", "case_id")).drop("_own").select(*table.columns)


def dedup_adjacent(rows: DataFrame, order: list, key: str = "image") -> tuple[DataFrame, DataFrame]:
    """(kept, repeats): a row that repeats the key of the row before it is a repeat."""
    seen = with_previous(global_index(rows, order, "_pos", "dedup"), "_pos", [key])
    repeat = F.col(key) == F.coalesce(f"prev_{key}", F.lit(""))
    return (seen.filter(~repeat).drop(f"prev_{key}"), seen.filter(repeat).drop(f"prev_{key}"))


def integrate(raw: Mapping[str, DataFrame], images: DataFrame, mode: str,
              near_duplicates: DataFrame | None = None,
              mismatched: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(training table, rejects with reason 'missing', 'duplicate' or 'mismatched').

    Missing pictures are dropped first: a row without a picture does not
    separate two equal neighbours.  ``line_no`` of the table is the row's place in
    reading order over all sources, so it is distinct; ``source_line`` is its
    number in its source, as in the rejects.
    """
    marked = J.mark_existing(union_sources(raw, mode, near_duplicates), images)
    # the rows are numbered already, so nothing is sorted as a whole
    seen = numbered_with_previous(marked.filter("exists").drop("exists"), "source_no", "line_no", "image", "_pos")
    repeat = F.col("image").eqNullSafe(F.col("prev_image"))
    kept, repeats = seen.filter(~repeat).drop("prev_image"), seen.filter(repeat).drop("prev_image")
    slim = ["image", "dataset", "line_no"]
    rejects = (marked.filter(~F.col("exists")).select(*slim, F.lit("missing").alias("reason"))
               .unionByName(repeats.select(*slim, F.lit("duplicate").alias("reason"))))
    if mismatched is not None:
        rejects = rejects.unionByName(mismatched.select("image", F.lit("challenge").alias("dataset"), "line_no",
                                                        F.lit("mismatched").alias("reason")))
    return kept.withColumn("source_line", F.col("line_no")).withColumn("line_no", F.col("_pos")).drop("_pos"), rejects
