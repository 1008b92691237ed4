"""Embedding whitening by spectral divide-and-conquer on polar decompositions.

Vectors become integers, so sums and means are exact.  Each distinct one is counted
once; tasks sum centred outer products, which are added in two levels.  The
covariance (dimensions squared, whatever the rows) is split on the driver: the polar
factor of its shifted copy, by the QR-based dynamically weighted Halley iteration,
gives the projector on the eigenvectors above the shift; both sides are split on
until single components remain.  Tasks then project every row with the components,
which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackpool.llm.vectors import matrices
from stackpool.session import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Partial sums that reach the driver at most.
FAN_IN = 32
EPS = np.finfo(np.float64).eps


# --- spectral divide-and-conquer ----------------------------------------------------------

def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by QDWH; singular directions may keep values inside (-1, 1)."""
    d = len(a)
    # Frobenius norms bound the singular values on both sides; a bound that is too wide costs an iteration, not accuracy
    x = a / np.linalg.norm(a)
    try:
        low = max(1.0 / np.linalg.norm(np.linalg.inv(x)), EPS / 4)
    except np.linalg.LinAlgError:
        low = EPS / 4
    for _ in range(30):
        if abs(low - 1.0) < 8 * EPS:
            break
        dd = np.cbrt(4.0 * (1.0 / low ** 2 - 1.0) / low ** 2)
        root = np.sqrt(1.0 + dd)
        wa = root + 0.5 * np.sqrt(max(8.0 - 4.0 * dd + 8.0 * (2.0 - low ** 2) / (low ** 2 * root), 0.0))
        wb = (wa - 1.0) ** 2 / 4.0
        wc = wa + wb - 1.0
        # the weighted Halley step without an inverse: [sqrt(c) X; I] = [Q1; Q2] R
        q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, np.eye(d)]))
        x = (wb / wc) * x + (wa - wb / wc) / np.sqrt(wc) * (q[:d] @ q[d:].T)
        x = (x + x.T) / 2
        low = min(low * (wa + wb * low ** 2) / (1.0 + wc * low ** 2), 1.0)
    # one plain Newton-Schulz step takes off what rounding left
    return 1.5 * x - 0.5 * x @ (x @ x)


def _halves(a: np.ndarray, size: float) -> tuple[np.ndarray, int] | None:
    """Orthogonal basis whose first k columns span the eigenvectors above some shift, or None where no shift parts them."""
    d = len(a)
    values = np.sort(np.diag(a))
    middle = values[d // 2 - 1:d // 2 + 1].mean() if d > 1 else values[0]
    mean = np.trace(a) / d
    spread = np.linalg.norm(a - mean * np.eye(d))
    # a shift that hits an eigenvalue is moved a little
    for shift in (middle, mean, *(mean + s * spread / np.sqrt(d) for s in (0.3, -0.3, 0.7, -0.7, 0.05, -0.05))):
        moved = a - shift * np.eye(d)
        if np.linalg.norm(moved) <= d * EPS * size:
            return None
        half = (polar(moved) + np.eye(d)) / 2
        k = int(round(np.trace(half)))
        if not 0 < k < d or np.linalg.norm(half @ half - half) > 1e-6:
            continue
        basis = np.linalg.qr(half @ np.random.default_rng(d).standard_normal((d, k)), mode="complete")[0]
        for _ in range(2):
            # subspace iteration on the projectors
            up = np.linalg.qr(half @ basis[:, :k])[0]
            basis = np.linalg.qr(np.hstack([up, basis[:, k:] - half @ basis[:, k:]]))[0]
        if np.linalg.norm(basis[:, k:].T @ a @ basis[:, :k]) <= 64 * d * EPS * size:
            return basis, k
    return None


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of a symmetric matrix."""
    size = np.linalg.norm(a)

    def split(block: np.ndarray) -> np.ndarray:
        d = len(block)
        off = block - np.diag(np.diag(block))
        if d == 1 or np.linalg.norm(off) <= EPS * size:
            return np.eye(d)
        parts = _halves(block, size)
        if parts is None and d == 2:
            # two directions with almost one eigenvalue: a rotation zeroes what is off the diagonal
            angle = 0.5 * np.arctan2(2 * block[0, 1], block[0, 0] - block[1, 1])
            return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        if parts is None:
            # eigenvalues that agree to rounding: every basis of theirs will do
            return np.eye(d)
        basis, k = parts
        up, low = basis[:, :k], basis[:, k:]
        return np.hstack([up @ split(_symmetric(up.T @ block @ up)), low @ split(_symmetric(low.T @ block @ low))])

    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    vectors = split(_symmetric(a))
    vectors = np.linalg.qr(vectors)[0]
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _symmetric(a: np.ndarray) -> np.ndarray:
    return (a + a.T) / 2


# --- fitting and applying -------------------------------------------------------------------

def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): floor(SCALE * entry) + OFFSET of each entry; rows without a vector or with an entry that is null or not finite go."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = rows.filter("vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    return whole.select("vec_id", F.transform("vector", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the vectors ``part`` of each ``d``, added up in two levels."""
    groups = parts.select("d", (F.spark_partition_id() % FAN_IN).alias("g"), array_to_vector("part").alias("part"))
    summed = groups.groupBy("d", "g").agg(Summarizer.sum(F.col("part")).alias("part")).collect()
    out: dict[int, np.ndarray] = {}
    for r in sorted(summed, key=lambda r: (r["d"], r["g"])):
        out[r["d"]] = out.get(r["d"], 0.0) + r["part"].toArray()
    return out


def totals(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(n, exact sum of each dimension) for each vector length."""
    sums = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    # one row per dimension
    for r in sums.collect():
        found.setdefault(r["d"], {})[r["i"]] = (r["n"], int(r["s"]))
    return {d: (rows[0][0], [rows[i][1] for i in range(d)]) for d, rows in found.items()}


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n.  The whole part of S / n is taken off as an integer, the rest (below 1) as a double."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole).astype(np.float64) - rest


def covariances(fit: DataFrame, known: dict[int, tuple[int, list[int]]], through: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """Covariance (divisor n) of the rows for each vector length, or with ``through`` that of their projections."""
    shared = fit.sparkSession.sparkContext.broadcast((known, through))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, maps = shared.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in matrices(batch):
                d = x.shape[1]
                y = _centred(x, *now[d])
                y = y if maps is None else y @ maps[d]
                if not y.shape[1]:
                    continue
                sums[d] = sums.get(d, 0.0) + y.T @ y
        yield pa.RecordBatch.from_pydict({"d": list(sums), "part": [s.ravel() for s in sums.values()]},
                                         schema=pa.schema([("d", pa.int32()), ("part", pa.list_(pa.float64()))]))
    schema = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("part", T.ArrayType(T.DoubleType()))])
    added = _added(fit.select(F.lit(None).cast("long").alias("vec_id"), "x").mapInArrow(partial, schema))
    shared.unpersist()
    return {d: s.reshape(int(np.sqrt(len(s))), -1) / known[d][0] for d, s in added.items()}


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, or hold null or non-finite entries, take no part.
    The fit list holds each distinct integer vector once, so copies weigh nothing.
    Components are numbered from 1 by falling eigenvalue; those without variance
    (at rounding) have no whitened value and no row, so one vector alone gives none.
    Vectors of several lengths are fitted apart.  Rows without vec_id and rows that
    repeat have rows of their own.  An empty table gives none.  ``deviation`` is exact;
    where it is above 2^63 - 1 the job fails.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col)
    fit = materialise(rows.select("x").distinct(), "fit")
    known = totals(fit)
    found = {d: spectrum(v) for d, v in covariances(fit, known).items()}
    maps, explained = {}, {}
    for d, (values, basis) in found.items():
        at = np.flatnonzero(values[:components] > d * EPS * max(values[0], 0.0))
        maps[d] = basis[:, at] / np.sqrt(values[at])
        explained[d] = values[at] / values.sum() if len(at) else values[at]
    error = dict.fromkeys(known, 0.0) | {d: float(np.abs(v - np.eye(len(v))).max()) for d, v in covariances(fit, known, maps).items()}
    shared = spark.sparkContext.broadcast((known, maps, explained, error))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ways, shares, errors = shared.value
        for batch in batches:
            ids = pa.RecordBatch.from_arrays([pa.array(np.arange(len(batch))), batch.column(1)], ["at", "x"])
            for at, x in matrices(ids):
                d = x.shape[1]
                n, sums = now[d]
                k = ways[d].shape[1]
                white = _centred(x, n, sums) @ ways[d]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                     pa.array(np.full(len(at) * k, n)), pa.array(np.repeat(_deviations(x, n, sums), k)), pa.array(white.ravel()),
                     pa.array(np.tile(shares[d], len(at))), pa.array(np.full(len(at) * k, errors[d]))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exactly."""
    whole = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=np.int64)
    if len(x) and (float(np.abs(x - whole).max()) + 1) * n * np.sqrt(x.shape[1]) < 2.0 ** 31:
        return ((n * (x - whole) - rest) ** 2).sum(axis=1)
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x.tolist()]
    return np.array(exact, dtype=object).astype(np.int64)
