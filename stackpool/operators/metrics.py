"""Evaluation of scores: AUC, average precision, accuracy, confusion, inversions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackpool.operators.order import global_index, score_curve
from stackpool.session import materialise


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom)


def ranking_metrics(df: DataFrame, score: str, positive: str, series: list[str] | None = None,
                    buckets: int | None = None) -> DataFrame:
    """Per series: exact ROC AUC (ties count half) and average precision.

    ``ap`` sums precision over recall steps; ``ap_trapezoid`` joins the points
    by straight lines, starting at recall 0 and precision 1.  A metric that is
    undefined because one class is missing is null.
    """
    return curve_metrics(score_curve(df, score, positive, series, buckets), series)


def curve_metrics(c: DataFrame, series: list[str] | None = None) -> DataFrame:
    """The same from a curve."""
    series = list(series or [])
    p, n = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp = (F.col("pos_total") - F.col("pos_below")).cast("double")
    fp = (F.col("neg_total") - F.col("neg_below")).cast("double")
    precision = tp / (tp + fp)
    above = tp + fp - p - n
    precision_above = F.when(above > 0, (tp - p) / F.nullif(above, F.lit(0.0))).otherwise(1.0)
    sums = c.groupBy(*series).agg(
        F.max("pos_total").cast("double").alias("_P"), F.max("neg_total").cast("double").alias("_N"),
        F.sum(p * (F.col("neg_below") + n / 2)).alias("_area"),
        F.sum(p * precision).alias("_ap"),
        F.sum(p * (precision + precision_above) / 2).alias("_apt"))
    P, N = F.col("_P"), F.col("_N")
    return sums.select(*series, _ratio(F.col("_area"), P * N).alias("auc"),
                       _ratio(F.col("_ap"), P).alias("ap"), _ratio(F.col("_apt"), P).alias("ap_trapezoid"))


def one_vs_rest(df: DataFrame, probabilities: str, truth: str, n_classes: int) -> DataFrame:
    """One row per (image, class): its score and whether the class is the truth."""
    return df.select(F.col(truth).alias("_t"), F.posexplode(F.slice(F.col(probabilities), 1, n_classes)).alias("class", "score")) \
        .select("class", "score", (F.col("_t") == F.col("class")).cast("int").alias("y"))


def accuracy(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(prediction)).cast("double")).alias("acc"))


def accuracy_truncated(df: DataFrame, label: str, scores: dict[int, str]) -> DataFrame:
    """Share of rows whose label equals the integer part of a score, per score column.

    Kept for comparison with old reports; :func:`accuracy` is the sound measure.
    """
    return df.agg(*[F.avg((F.col(label) == F.col(s).cast("int")).cast("double")).alias(f"acc_{j}")
                    for j, s in scores.items()])


def confusion_matrix(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """Counts for every pair of labels seen as truth or prediction, zeros included."""
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
    # the label list is as long as there are classes
    labels = counts.select(F.explode(F.array("truth", "prediction")).alias("l")).agg(F.collect_set("l").alias("ls"))
    grid = labels.select(F.explode("ls").alias("truth"), "ls").select("truth", F.explode("ls").alias("prediction"))
    return grid.join(counts, ["truth", "prediction"], "left").select(
        "truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def metrics_row(pooled: DataFrame, truth: str, checkpoint: str, n_classes: int = 3) -> DataFrame:
    """One row: checkpoint, acc, auc of classes 1 and 2, ap of classes 1 and 2, mean auc."""
    m = ranking_metrics(one_vs_rest(pooled, "probabilities", truth, n_classes), "score", "y", ["class"])
    cells = m.select(F.explode(F.array(
        F.struct(F.concat(F.lit("auc"), F.col("class").cast("string")).alias("name"), F.col("auc").alias("value")),
        F.struct(F.concat(F.lit("map"), F.col("class").cast("string")).alias("name"), F.col("ap").alias("value")))).alias("cell"))
    cells = cells.select("cell.*").unionByName(
        accuracy(pooled, truth, "prediction").select(F.lit("acc").alias("name"), F.col("acc").alias("value")))
    wide = cells.agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
                       for n in ("acc", "auc1", "auc2", "map1", "map2")])
    return wide.select(F.lit(checkpoint).alias("checkpoint"), "*",
                       ((F.col("auc1") + F.col("auc2")) / 2).alias("isbi"))


# --- rank inversions -------------------------------------------------------

def rank_scores(df: DataFrame, score: str, line_no: str, name: str = "rank") -> DataFrame:
    """0-based rank by score, ties in file order."""
    return global_index(df, [score, line_no], name, "rank")


def inversions_in(values: np.ndarray) -> int:
    """Pairs i < j with values[i] > values[j], bit by bit from the top, without loops over rows."""
    n = len(values)
    if n < 2:
        return 0
    _, v = np.unique(values, return_inverse=True)
    total = 0
    for bit in range(int(v.max()).bit_length() - 1, -1, -1):
        prefix = v >> (bit + 1)
        order = np.argsort(prefix, kind="stable")
        group, ones = prefix[order], (v[order] >> bit) & 1
        seen = np.cumsum(ones)
        first = np.r_[True, group[1:] != group[:-1]]
        base = np.maximum.accumulate(np.where(first, seen - ones, 0))
        total += int(((seen - base) * (1 - ones)).sum())
    return total


def _both_counts(values: np.ndarray, classes: np.ndarray) -> tuple[int, int]:
    same = sum(inversions_in(values[classes == c]) for c in np.unique(classes))
    return inversions_in(values), same


#: Rows of a block of either order, and blocks that a wider block joins.
BLOCK_ROWS, FAN = 1 << 16, 64


def _pairs_between_chunks(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per group, pairs of rows whose chunks differ: the earlier one has the larger child.

    ``cells`` has the keys, chunk and n0..n63, the rows of each child; a running
    sum over the chunks of a group gives the earlier rows of each child.
    """
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    here = F.array(*[F.col(f"n{k}") for k in range(FAN)])
    earlier = F.array(*[F.coalesce(F.sum(f"n{k}").over(before), F.lit(0)) for k in range(FAN)])
    both = cells.select(F.reverse(F.arrays_zip(here.alias("n"), earlier.alias("b"))).alias("x"))
    start = F.struct(F.lit(0).cast("long").alias("larger"), F.lit(0).cast("decimal(38,0)").alias("total"))
    step = lambda s, x: F.struct((s["larger"] + x["b"]).alias("larger"),
                                 (s["total"] + (x["n"].cast("decimal(18,0)") * s["larger"].cast("decimal(18,0)"))).cast("decimal(38,0)").alias("total"))
    return both.select(F.aggregate("x", start, step, lambda s: s["total"]).alias("pairs"))


def count_inversions(ranked: DataFrame, rank1: str, rank2: str, truth: str, block_rows: int | None = None) -> DataFrame:
    """Pairs ordered differently by two dense rankings, and those of different truth (decimals of 38 digits).

    Order 1 is a tree: blocks of ``block_rows`` ranks (BLOCK_ROWS unless given), FAN of which make a wider
    block, and so on up to one.  A pair is found once, in the lowest block that
    holds both rows: there its children differ, unless it is a lowest block.
    Order 2 cuts each block into chunks of ``block_rows`` ranks; pairs inside a
    chunk are counted in its task, pairs between chunks from counts.  No task holds
    more than ``block_rows`` rows, and no pairs are made.
    """
    block_rows = block_rows or BLOCK_ROWS
    # read once for each level of the tree
    rows = materialise(ranked.select(F.col(rank1).cast("long").alias("r1"), F.col(rank2).cast("long").alias("r2"),
                                     F.col(truth).cast("int").alias("t")), "ranks")
    schema = "total long, same long"

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r1")
        return pd.DataFrame([_both_counts(pdf["r2"].to_numpy(), pdf["t"].to_numpy())], columns=["total", "same"])

    def in_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("r2")
        return pd.DataFrame([_both_counts(pdf["child"].to_numpy(), pdf["t"].to_numpy())], columns=["total", "same"])

    wide = lambda d: d.select(F.col("total").cast("decimal(38,0)").alias("total"), F.col("same").cast("decimal(38,0)").alias("same"))
    none = F.lit(0).cast("decimal(38,0)")
    found = wide(rows.withColumn("block", F.floor(F.col("r1") / F.lit(block_rows))).groupBy("block").applyInPandas(in_block, schema))
    last, span = rows.agg(F.max("r1").alias("last")).first()["last"] or 0, block_rows
    while span <= last:
        level = (rows.withColumn("child", (F.floor(F.col("r1") / F.lit(span)) % FAN).cast("int"))
                 .withColumn("block", F.floor(F.col("r1") / F.lit(span * FAN))).withColumn("chunk", F.floor(F.col("r2") / F.lit(block_rows))))
        found = found.unionByName(wide(level.groupBy("block", "chunk").applyInPandas(in_chunk, schema)))
        cells = level.groupBy("block", "chunk", "t").agg(*[F.sum((F.col("child") == k).cast("long")).alias(f"n{k}") for k in range(FAN)])
        every = cells.groupBy("block", "chunk").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(FAN)])
        found = found.unionByName(_pairs_between_chunks(every, ["block"]).select(F.col("pairs").alias("total"), none.alias("same")))
        found = found.unionByName(_pairs_between_chunks(cells, ["block", "t"]).select(none.alias("total"), F.col("pairs").alias("same")))
        span *= FAN
    return found.agg(F.coalesce(F.sum("total"), none).cast("decimal(38,0)").alias("inversions"),
                     F.coalesce(F.sum(F.col("total") - F.col("same")), none).cast("decimal(38,0)").alias("significant"))
