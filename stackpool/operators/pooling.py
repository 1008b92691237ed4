"""Pooling of replica scores, replica features and final probabilities."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackpool.functions import scores as S
from stackpool.operators.order import run_starts
from stackpool.session import materialise

SCORE_MODES = ("avg", "max", "avg_logits", "max_logits", "xtrm_logits", "none")
FEATURE_MODES = ("avg", "max", "xtrm", "none")
ID_MODES = ("none", "avg", "max", "xtrm")


def _check(mode: str, allowed: tuple[str, ...], what: str) -> None:
    if mode not in allowed:
        raise ValueError(f"{what} must be one of {' '.join(allowed)}, got {mode!r}")


#: Orders of rows lie below this.
ORDERS = 1 << 62


def extreme(value: Column, size: Column, order: Column) -> Column:
    """Aggregate: the value of greatest ``size``, the earliest by ``order`` on ties."""
    return F.max_by(value, F.struct(size, -order))


def certainty(p: Column) -> Column:
    """Orders probabilities as the size of their log-odds does, 0 and 1 being the most certain.

    Both p and 1 - p are exact where they are the smaller one, so equal
    certainty is found equal; logarithms would differ in the last bit.
    """
    return -F.least(p, 1.0 - p)


def pool_scores(df: DataFrame, ids: list[str], logits: str, mode: str, n_classes: int,
                replica: str = "replica", carry: list[str] = ()) -> DataFrame:
    """Pool the logits of all replicas of an image.

    One aggregate expression per class, so replicas combine map-side and the
    shuffle moves one partial row per image and task.  ``carry`` columns are
    constant within an image.
    """
    _check(mode, SCORE_MODES, "pool_scores")
    if mode == "none":
        z = [F.col(logits)[i] for i in range(n_classes)]
        out = df.select(*ids, *carry, F.col(replica), F.array(*S.softmax_list(z)).alias("probabilities"),
                        F.col(logits).alias("logits"))
        return out.withColumn("prediction", S.argmax("probabilities"))
    out = df.groupBy(*ids).agg(*[F.min(c).alias(c) for c in carry], *_score_aggregates(logits, mode, n_classes, replica))
    return _finish_scores(out, mode, n_classes).select(*ids, *carry, "probabilities", "logits", "prediction")


def _score_aggregates(logits: str, mode: str, n_classes: int, replica: str) -> list[Column]:
    z = [F.col(logits)[i] for i in range(n_classes)]
    if mode in ("avg", "max"):
        fold = F.avg if mode == "avg" else F.max
        return [F.array(*[fold(p) for p in S.softmax_list(z)]).alias("probabilities"),
                F.array(*[fold(v) for v in z]).alias("logits")]
    if mode == "xtrm_logits":
        return [F.array(*[extreme(v, F.abs(v), F.col(replica)) for v in z]).alias("logits")]
    fold = F.avg if mode == "avg_logits" else F.max
    return [F.array(*[fold(v) for v in z]).alias("logits")]


def _finish_scores(df: DataFrame, mode: str, n_classes: int) -> DataFrame:
    if mode not in ("avg", "max"):
        df = df.withColumn("probabilities", S.softmax("logits", n_classes))
    return df.withColumn("prediction", S.argmax("probabilities"))


def pool_both(df: DataFrame, ids: list[str], logits: str, features: str, score_mode: str, feature_mode: str,
              n_classes: int, replica: str = "replica") -> DataFrame:
    """Scores and features pooled together, so that what produced them runs once."""
    _check(score_mode, SCORE_MODES, "pool_scores")
    _check(feature_mode, FEATURE_MODES, "pool_features")
    if (score_mode == "none") != (feature_mode == "none"):
        raise ValueError("scores and features must both be pooled or both not")
    if score_mode == "none":
        out = df.select(*ids, replica, features, logits,
                        S.softmax(logits, n_classes).alias("probabilities"))
        return out.withColumn("prediction", S.argmax("probabilities"))
    if feature_mode == "xtrm":
        # two reductions, so the scored rows are needed twice
        stored = materialise(df.select(*ids, replica, logits, features), "scored")
        return pool_features(stored, ids, features, feature_mode, replica).join(
            pool_scores(stored, ids, logits, score_mode, n_classes, replica), ids)
    stat = Summarizer.mean if feature_mode == "avg" else Summarizer.max
    out = df.groupBy(*ids).agg(stat(array_to_vector(F.col(features))).alias("_v"),
                               *_score_aggregates(logits, score_mode, n_classes, replica))
    return _finish_scores(out.withColumn(features, vector_to_array("_v")).drop("_v"), score_mode, n_classes)


def pool_features(df: DataFrame, ids: list[str], features: str, mode: str,
                  replica: str = "replica", carry: list[str] = ()) -> DataFrame:
    """Pool feature vectors of any width over the replicas of an image.

    Average and maximum use the vector summarizer: one buffer of the vector's
    width per image, combined map-side.  The signed extreme is reduced in the tasks
    before and after the shuffle.
    """
    _check(mode, FEATURE_MODES, "pool_features")
    if mode == "none":
        return df.select(*ids, *carry, replica, features)
    keep = [F.min(c).alias(c) for c in carry]
    if mode in ("avg", "max"):
        stat = Summarizer.mean if mode == "avg" else Summarizer.max
        return (df.groupBy(*ids).agg(*keep, stat(array_to_vector(F.col(features))).alias("_v"))
                .select(*ids, *carry, vector_to_array("_v").alias(features)))
    return _extreme_vectors(df, ids, features, replica, carry)


def _extremes_by_key(n_keys: int) -> Callable:
    """A mapInArrow function: rows (keys, carried columns, orders, vectors) to one row for each key of a batch.

    The last key of a batch waits for the next one, so of sorted rows every key
    gives one row.  Nothing but a batch and one vector is held.
    """
    def matrix(column: pa.Array, rows: int) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if pc.count_distinct(pc.list_value_length(column)).as_py() > 1:
            raise ValueError("feature vectors of one table must be equally wide")
        return flat.reshape(rows, -1)

    def furthest(x: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.where(np.isnan(x), np.inf, np.abs(x))
        at = np.where(size == size.max(axis=0), order, ORDERS).argmin(axis=0), np.arange(x.shape[1])
        return x[at], order[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, held = None, None, None

        def result(rows: list, found: list) -> pa.RecordBatch:
            plain = pa.Table.from_batches(rows).combine_chunks().to_batches()[0].columns[:-2]
            return pa.RecordBatch.from_arrays([*plain, pa.array([f[1] for f in found], pa.list_(pa.int64())),
                                               pa.array([f[0] for f in found], pa.list_(pa.float64()))], names=rows[0].schema.names)
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            places: dict = {}
            for i, k in enumerate(zip(*[c.to_pylist() for c in batch.columns[:n_keys]])):
                places.setdefault(k, []).append(i)
            x = matrix(batch.columns[-1], n)
            order = matrix(batch.columns[-2], n)
            order = np.broadcast_to(order, x.shape)
            rows, found = [], []
            if key is not None and key not in places:
                rows, found = [row], [held]
            for k, at in places.items():
                mine, when = x[at], order[at]
                if k == key:
                    mine, when = np.vstack([held[0], mine]), np.vstack([held[1], when])
                found.append(furthest(mine, when))
                rows.append(batch.slice(at[0], 1))
            key, row, held = k, rows.pop(), found.pop()
            if rows:
                yield result(rows, found)
        if key is not None:
            yield result([row], [held])
    return run


def _extreme_vectors(df: DataFrame, ids: list[str], features: str, replica: str, carry: list[str]) -> DataFrame:
    """Per position the value furthest from zero, the earliest replica on ties.

    Vectors are reduced where they lie, one for each image and batch, and again
    after the shuffle from sorted rows; no image is held as a whole, whatever
    its number of replicas.  Images without any vector give no row.
    """
    kind = df.schema[features].dataType
    rows = df.filter(F.size(features) > 0).select(*ids, *carry, F.array(F.col(replica).cast("long")).alias("_order"),
                                                  F.col(features).cast("array<double>").alias(features))
    reduce = _extremes_by_key(len(ids))
    partial = rows.mapInArrow(reduce, rows.schema)
    whole = partial.repartition(*[F.col(c) for c in ids]).sortWithinPartitions(*ids).mapInArrow(reduce, rows.schema)
    return whole.select(*ids, *carry, F.col(features).cast(kind).alias(features))


def aggregate_replicas(df: DataFrame, id_col: str, label: str, features: str, idx: str,
                       group_rows: int = 50, short: bool = False) -> DataFrame:
    """Mean feature vector of every ``group_rows`` contiguous rows of one id.

    The query fails if a group is incomplete or mixes ids; the label is that
    of the first row of the group.  With ``short`` a group of fewer rows, such as
    the last one, is the mean of the rows it has.
    """
    grouped = (df.groupBy(F.floor(F.col(idx) / F.lit(group_rows)).alias("grp"))
               .agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias(id_col), F.max(id_col).alias("_last"),
                    F.min_by(label, idx).alias(label),
                    Summarizer.mean(array_to_vector(F.col(features))).alias("_v")))
    size = F.col("_n") > group_rows if short else F.col("_n") != group_rows
    bad = size | (F.col(id_col) != F.col("_last"))
    message = F.concat(F.lit(f"aggregation needs groups of {group_rows} contiguous records of one id; see group "),
                       F.col("grp").cast("string"))
    checked = F.when(bad, F.raise_error(message)).otherwise(vector_to_array("_v"))
    return grouped.select(id_col, "grp", label, checked.alias(features))


def pool_by_id(df: DataFrame, id_col: str, columns: list[str], mode: str, idx: str,
               contiguous: bool = True) -> DataFrame:
    """Pool final probabilities by id; each task's column is pooled on its own.

    With ``contiguous`` a recurring id starts a new result whenever another id
    came between (``idx`` is the dense row position).  ``xtrm`` keeps the
    probability furthest from one half in log-odds, the first one on ties.
    """
    _check(mode, ID_MODES, "pool_by_id")
    if mode == "none":
        return df.select(id_col, F.col(idx).alias("run_start"), *columns)
    if contiguous:
        df = run_starts(df, idx, id_col)
        keys = [id_col, "run_start"]
    else:
        keys = [id_col]
    if mode == "avg":
        aggs = [F.avg(c).alias(c) for c in columns]
    elif mode == "max":
        aggs = [F.max(c).alias(c) for c in columns]
    else:
        aggs = [extreme(F.col(c), certainty(F.col(c)), F.col(idx)).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggs)
