"""Order-dependent building blocks that never put an unbounded group in one task.

``global_index``     dense 0-based position in a total order (range sort + block offsets)
``with_previous``    value of the row before, over a dense index, in fixed-size chunks
``run_starts``       start position of the run of equal values a row belongs to
``running_before``   running aggregate of all earlier rows of a series
``score_counts``     positives and negatives at each distinct score, which merge
``score_curve``      per distinct score: counts at and below it, for AUC and AP

A series or value that holds a third of all rows is spread over many chunks;
only per-chunk totals (one row per chunk) meet in a single window.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackpool.session import materialise, shuffle_partitions

CHUNK_ROWS = 1 << 20


def global_index(df: DataFrame, order: list, name: str = "idx", tag: str = "index") -> DataFrame:
    """Add the dense position of each row in the total order ``order``.

    One range shuffle.  The sorted rows are written once, because range bounds
    are sampled and a second evaluation could place rows elsewhere.  The id
    given inside a sorted partition is (partition << 33) + position, so the
    position needs only the sizes of the partitions before it.
    """
    stored = materialise(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), tag)
    block = F.shiftright("_mid", 33)
    sizes = stored.groupBy(block.alias("_block")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per sort partition
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # bounded: one row per sort partition
    return (stored.withColumn("_block", block)
            .join(F.broadcast(starts), "_block")
            .withColumn(name, F.col("_start") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
            .drop("_block", "_start", "_mid"))


def with_previous(df: DataFrame, idx: str, columns: list[str], chunk_rows: int = CHUNK_ROWS,
                  keep_chunk: bool = False) -> DataFrame:
    """Add ``prev_<column>`` of the row at ``idx - 1`` (null for the first row).

    Rows are cut into chunks of ``chunk_rows`` positions.  The last row of a
    chunk is also sent to the next chunk, so no join is needed at the borders.
    """
    chunk = F.floor(F.col(idx) / F.lit(chunk_rows))
    is_last = (F.col(idx) + 1) % chunk_rows == 0
    spread = df.withColumn("_chunk", F.explode(
        F.when(is_last, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))))
    w = Window.partitionBy("_chunk").orderBy(idx)
    for c in columns:
        spread = spread.withColumn(f"prev_{c}", F.lag(c).over(w))
    out = spread.filter(F.col("_chunk") == chunk)
    return out if keep_chunk else out.drop("_chunk")


def numbered_with_previous(df: DataFrame, major: str, line: str, column: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Dense position and ``prev_<column>`` in the order (major, line), for rows whose lines are numbered already.

    Lines are cut into chunks of ``chunk_rows`` numbers.  The last row and the
    size of each chunk meet in a table of one row per chunk, so no row is sorted
    outside its chunk and nothing is written.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(line) / F.lit(chunk_rows)))
    totals = chunked.groupBy(major, "_chunk").agg(F.count(F.lit(1)).alias("_size"), F.max_by(column, line).alias("_last"))
    # one row per chunk
    order = Window.orderBy(major, "_chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(major, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
                          F.lag("_last").over(order).alias("_carry"))
    inside = Window.partitionBy(major, "_chunk").orderBy(line)
    local = chunked.withColumn("_row", F.row_number().over(inside)).withColumn("_local", F.lag(column).over(inside))
    return (local.join(carry, [major, "_chunk"])
            .withColumn(f"prev_{column}", F.when(F.col("_row") > 1, F.col("_local")).otherwise(F.col("_carry")))
            .withColumn(name, F.col("_start") + F.col("_row") - 1)
            .drop("_chunk", "_row", "_local", "_start", "_carry"))


def run_starts(df: DataFrame, idx: str, value: str, name: str = "run_start",
               chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add the index at which the current run of equal ``value`` began."""
    prev = with_previous(df, idx, [value], chunk_rows, keep_chunk=True)
    starts_here = (F.col(idx) == 0) | ~F.col(f"prev_{value}").eqNullSafe(F.col(value))
    marked = prev.withColumn("_start", F.when(starts_here, F.col(idx)))
    w = Window.partitionBy("_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_local", F.max("_start").over(w))
    # one row per chunk
    ends = marked.groupBy("_chunk").agg(F.max("_start").alias("_end"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select("_chunk", F.max("_end").over(before).alias("_carry"))
    return (local.join(carry, "_chunk")
            .withColumn(name, F.coalesce("_local", "_carry"))
            .drop("_chunk", "_start", "_local", "_carry", f"prev_{value}"))


def running_before(df: DataFrame, series: list[str], order: list, aggregates: dict[str, Column],
                   combine: dict[str, str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Running aggregate over the earlier rows of the same series.

    ``aggregates`` maps an output name to an aggregate column (``F.max("x")``);
    ``combine`` names how partial results merge: ``max`` or ``sum``.
    The first row of a series gets null.
    """
    indexed = global_index(df, [*series, *order], "_idx", "running")
    chunked = indexed.withColumn("_chunk", F.floor(F.col("_idx") / F.lit(chunk_rows)))
    w = Window.partitionBy(*series, "_chunk").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    local = chunked
    for name, agg in aggregates.items():
        local = local.withColumn(f"_l_{name}", agg.over(w))
    totals = chunked.groupBy(*series, "_chunk").agg(*[a.alias(f"_t_{n}") for n, a in aggregates.items()])
    before = Window.partitionBy(*series).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    merge = {"max": F.max, "sum": F.sum}
    carry = totals.select(*series, "_chunk", *[
        merge[combine[n]](f"_t_{n}").over(before).alias(f"_c_{n}") for n in aggregates])
    out = local.join(carry, [*series, "_chunk"])
    for n in aggregates:
        l, c = F.col(f"_l_{n}"), F.col(f"_c_{n}")
        both = F.greatest(l, c) if combine[n] == "max" else l + c
        out = out.withColumn(n, F.coalesce(both, l, c))
    return out.drop("_idx", "_chunk", *[f"{p}{n}" for n in aggregates for p in ("_l_", "_c_")])


def score_buckets(df: DataFrame, score: str, n: int | None = None) -> list[float]:
    """Row quantiles of a score, as inner borders of value ranges of similar row count.

    One combinable sketch over the scan; at most ``n`` numbers reach the driver.
    """
    n = n or shuffle_partitions(df.sparkSession)
    points = [i / n for i in range(1, n)]
    found = df.agg(F.percentile_approx(F.col(score), points, max(1_000, 20 * n)).alias("q")).first()["q"]
    return sorted({float(q) for q in found or [] if q == q and abs(q) != float("inf")})


def add_bucket(df: DataFrame, score: str, borders: list[float], name: str = "_bucket") -> DataFrame:
    splits = [-float("inf"), *borders, float("inf")]
    found = Bucketizer(splits=splits, inputCol=score, outputCol="_b", handleInvalid="keep").transform(df)
    return found.withColumn(name, F.col("_b").cast("int")).drop("_b")


def score_counts(df: DataFrame, score: str, positive: str, series: list[str] | None = None) -> DataFrame:
    """Positives and negatives at each distinct score of a series: (series, score, pos, neg).

    Counts of disjoint rows add up, so tables of them can be merged.
    """
    series = list(series or [])
    value, label = F.col(score).cast("double"), F.col(positive).cast("long")
    bad = F.raise_error(F.lit(f"a score in {score} or a label in {positive} is null or not a number"))
    slim = df.select(*series, F.when(value.isNull() | F.isnan(value) | label.isNull(), bad).otherwise(value).alias("score"), label.alias("_y"))
    return slim.groupBy(*series, "score").agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))


def score_curve(df: DataFrame, score: str, positive: str, series: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Per (series, distinct score): positives and negatives at it, below it and in total.

    The rows are read once: equal scores collapse in a map-side partial aggregate,
    so a score shared by a third of the rows costs one row, and the counts of
    distinct scores are stored.
    """
    return curve_of_counts(materialise(score_counts(df, score, positive, series), "scores"), series, buckets)


def curve_of_counts(counts: DataFrame, series: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """The curve of a stored table of ``score_counts``.

    Its rows are read for the borders of the ranges of scores, for the totals of
    the ranges (both combine to a few numbers per task) and for the ranks within.
    """
    series = list(series or [])
    ranged = add_bucket(counts, "score", score_buckets(counts, "score", buckets))
    inside = Window.partitionBy(*series, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("_pin"),
                          F.coalesce(F.sum("neg").over(inside), F.lit(0)).alias("_nin"))
    # at most n buckets per series
    sums = ranged.groupBy(*series, "_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    whole = Window.partitionBy(*series)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *series, "_bucket",
        F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_pb"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_nb"),
        F.sum("_p").over(whole).alias("pos_total"), F.sum("_n").over(whole).alias("neg_total"))
    return (local.join(offsets, [*series, "_bucket"])
            .withColumn("pos_below", F.col("_pin") + F.col("_pb"))
            .withColumn("neg_below", F.col("_nin") + F.col("_nb"))
            .select(*series, "score", "pos", "neg", "pos_below", "neg_below", "pos_total", "neg_total"))
