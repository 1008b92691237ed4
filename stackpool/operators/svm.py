"""Linear SVMs (squared hinge, L2) for many settings at once, and their random search.

All (task, C, fold) models are columns of one weight matrix.  One pass sums the
products of features for each kernel map and fold; with these every model has the
Hessian that it would have if each of its rows were within the margin.  Quasi-Newton
steps preconditioned by it need some ten passes where plain ones need thousands.
Models that need more, such as those of strong penalties on parted classes, follow
their penalty upwards by Newton steps on the rows within their margin.  In a pass each task turns its Arrow batches into two
matrix products and emits one row of summed losses and gradients; partial rows are
added in two levels, so the last step sees few of them however many partitions
there are.  Weights and sums, not rows, come to the driver.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackpool.functions.draws import shuffle_key, uniform, uniforms
from stackpool.functions.scores import linear_score, sigmoid
from stackpool.operators.features import Preprocessor, fourier_basis, fourier_map, random_fourier
from stackpool.operators.metrics import ranking_metrics
from stackpool.operators.order import global_index

# Search range of log2 C, folds, default number of trials.
C_LOW, C_SCALE = -16.0, 32.0
GAMMA_TOP, GAMMA_SPAN = 3.0, 32.0
FOLDS = 3
TRIALS = 10
#: Passes after which a fit that has not converged is an error.
MAX_ITER = 200
TASKS = {"melanoma": 1, "keratosis": 2}
ALL_ROWS = -1
# At most this many partial sums reach the driver in one iteration.
FAN_IN = 32
# Bytes of feature products that a task sums up in one pass, and values in one row of them.
PRODUCT_BYTES, PRODUCT_ROW = 64 << 20, 1 << 14
# Passes after which models that are left follow their penalty, by steps of this factor.
QUICK, PENALTY_STEP = 24, 16.0


def gamma_range(n_samples: int) -> tuple[float, float]:
    """(low, scale) of log2 gamma from the number of samples."""
    low = float(np.floor(np.log2(1.0 / n_samples)) - 4.0)
    return low, min(GAMMA_TOP, low + GAMMA_SPAN) - low


def draw_c(trial: int, seed: int = 0) -> float:
    return 2.0 ** (C_LOW + C_SCALE * uniforms(seed, "C", trial)[0])


def trial_table(spark: SparkSession, n_trials: int, n_samples: int, seed: int = 0) -> DataFrame:
    """Log-uniform C and gamma of each trial."""
    low, scale = gamma_range(n_samples)
    t = spark.range(n_trials).select(F.col("id").cast("int").alias("trial"))
    return t.select("trial", F.pow(F.lit(2.0), C_LOW + C_SCALE * uniform(seed, F.lit("C"), F.col("trial"))).alias("c"),
                    F.pow(F.lit(2.0), low + scale * uniform(seed, F.lit("gamma"), F.col("trial"))).alias("gamma"))


def group_folds(df: DataFrame, id_col: str, k: int = FOLDS, method: str = "hash", seed: int = 0) -> DataFrame:
    """Fold per row such that no id is in two folds.

    ``hash`` needs no shuffle.  ``balanced`` deals the ids out by falling row
    count; only the table of ids is sorted.
    """
    if method == "hash":
        digest = F.conv(F.substring(shuffle_key(seed, id_col), 1, 8), 16, 10).cast("long")
        return df.withColumn("fold", (digest % k).cast("int"))
    if method != "balanced":
        raise ValueError("method must be hash or balanced")
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    dealt = global_index(per_id, [F.desc("_n"), shuffle_key(seed, id_col)], "_i", "folds")
    return df.join(dealt.select(id_col, (F.col("_i") % k).cast("int").alias("fold")), id_col)


def stratified_folds(df: DataFrame, label: str, row_id: str, k: int = FOLDS, seed: int = 0) -> DataFrame:
    """Fold per row with even class shares, ignoring groups: rows are dealt out class after class."""
    dealt = global_index(df, [label, shuffle_key(seed, row_id)], "_i", "folds")
    return dealt.withColumn("fold", (F.col("_i") % k).cast("int")).drop("_i")


@dataclass(frozen=True)
class Setting:
    """One model: label taken as positive, penalty, the fold it must not see, and which kernel map its rows go through."""
    positive: int
    c: float
    held_out: int = ALL_ROWS
    kernel: int = -1


Basis = tuple[np.ndarray, np.ndarray]


def _mapped(x: np.ndarray, settings: list[Setting], bases: list[Basis]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, rows with the constant feature) for each kernel that the settings use."""
    kernels = np.array([s.kernel for s in settings])
    for k in np.unique(kernels):
        rows = x if k < 0 else fourier_map(x, bases[k])
        yield np.flatnonzero(kernels == k), np.hstack([rows, np.ones((len(rows), 1))])


def _sum_over_rows(df: DataFrame, weights: np.ndarray, settings: list[Setting], features: str, label: str,
                   bases: list[Basis] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Summed squared hinge and its gradient per setting, for weights of shape (d + 1, k)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((weights, list(bases)))
    positive = np.array([s.positive for s in settings])
    held = np.array([s.held_out for s in settings])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, maps = shared.value
        loss, grad = np.zeros(w.shape[1]), np.zeros(w.shape)
        for pdf in batches:
            if pdf.empty:
                continue
            for at, x in _mapped(np.stack(pdf[features].to_numpy()), settings, maps):
                y = np.where(pdf[label].to_numpy()[:, None] == positive[at], 1.0, -1.0)
                slack = np.maximum(0.0, 1.0 - y * (x @ w[:, at])) * (pdf["fold"].to_numpy()[:, None] != held[at])
                loss[at] += (slack ** 2).sum(axis=0)
                grad[:, at] -= 2.0 * x.T @ (y * slack)
        yield pd.DataFrame({"part": [np.concatenate([loss, grad.ravel()])]})

    schema = T.StructType([T.StructField("part", T.ArrayType(T.DoubleType()))])
    parts = df.select(features, label, "fold").mapInPandas(partial, schema)
    # one weight-sized row per partition, added in two levels whatever their number
    groups = parts.select((F.spark_partition_id() % FAN_IN).alias("g"), array_to_vector("part").alias("part"))
    summed = groups.groupBy("g").agg(Summarizer.sum(F.col("part")).alias("part"))
    total = np.sum([r["part"].toArray() for r in sorted(summed.collect(), key=lambda r: r["g"])], axis=0)
    shared.unpersist()
    k = len(settings)
    return total[:k], total[k:].reshape(weights.shape)


def _summed_products(df: DataFrame, width: int, columns: list[str], keys: list[int], task: Callable[[list[int], Iterator[pd.DataFrame]], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sum over all tasks of the symmetric matrices ``task(keys, batches)`` gives per key.

    A task holds PRODUCT_BYTES of them at most, further keys take further passes.
    Upper triangles travel in short rows; each adding task streams over all partial
    rows of its share of the values.
    """
    upper = np.triu_indices(width)
    per_pass = max(1, PRODUCT_BYTES // (8 * len(upper[0])))
    out: dict[int, np.ndarray] = {}
    for start in range(0, len(keys), per_pass):
        group = keys[start:start + per_pass]

        def partial(batches: Iterator[pd.DataFrame], group=group) -> Iterator[pd.DataFrame]:
            for key, total in task(group, batches).items():
                flat = total[np.triu_indices(width)]
                for at in range(0, len(flat), PRODUCT_ROW):
                    yield pd.DataFrame({"key": [key], "at": [at], "part": [flat[at:at + PRODUCT_ROW]]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                for key, at, part in pdf.itertuples(index=False):
                    total[key, at] = total.get((key, at), 0.0) + part
            for (key, at), t in total.items():
                yield pd.DataFrame({"key": [key], "at": [at], "part": [t]})

        schema = "key int, at int, part array<double>"
        summed = df.select(*columns).mapInPandas(partial, schema).repartition("key", "at").mapInPandas(add, schema)
        flats = {key: np.zeros(len(upper[0])) for key in group}
        for batch in summed.toArrow().to_batches():
            for key, at, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                flats[key][at:at + PRODUCT_ROW] = part.values.to_numpy()
        for key, flat in flats.items():
            full = np.zeros((width, width))
            full[upper] = flat
            out[key] = full + np.triu(full, 1).T
    return out


def _feature_products(df: DataFrame, width: int, settings: list[Setting], features: str, bases: list[Basis]) -> dict[tuple[int, int], np.ndarray]:
    """Sum of x x^T over the rows that a (kernel, held-out fold) leaves, for each one that the settings name.

    Rows are summed per kernel and fold that some setting holds out, all others together.
    """
    folds = [*sorted({s.held_out for s in settings} - {ALL_ROWS}), ALL_ROWS]
    kernels = sorted({s.kernel for s in settings})
    shared = df.sparkSession.sparkContext.broadcast(list(bases))

    def task(keys: list[int], batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        total = {key: np.zeros((width, width)) for key in keys}
        members = [Setting(0, 0.0, kernel=k) for k in sorted({kernels[key // len(folds)] for key in keys})]
        for pdf in batches:
            if pdf.empty:
                continue
            fold = pdf["fold"].to_numpy()
            own = np.where(np.isin(fold, folds), fold, ALL_ROWS)
            for at, x in _mapped(np.stack(pdf[features].to_numpy()), members, shared.value):
                base = kernels.index(members[at[0]].kernel) * len(folds)
                for j, f in enumerate(folds):
                    if base + j in total and (own == f).any():
                        rows = x[own == f]
                        total[base + j] += rows.T @ rows
        return total

    sums = _summed_products(df, width, [features, "fold"], list(range(len(kernels) * len(folds))), task)
    shared.unpersist()
    wanted = {(s.kernel, s.held_out) for s in settings}
    per = {k: [sums[i * len(folds) + j] for j in range(len(folds))] for i, k in enumerate(kernels)}
    return {(k, f): sum(p for j, p in enumerate(per[k]) if f == ALL_ROWS or folds[j] != f) for k, f in wanted}


def _active_products(df: DataFrame, w: np.ndarray, which: np.ndarray, settings: list[Setting], features: str, label: str, bases: list[Basis]) -> dict[int, np.ndarray]:
    """Sum of x x^T over the rows within the margin, for each setting of ``which``."""
    shared = df.sparkSession.sparkContext.broadcast((w, list(bases)))

    def task(keys: list[int], batches: Iterator[pd.DataFrame]) -> dict[int, np.ndarray]:
        weights, maps = shared.value
        total = {key: np.zeros((len(weights), len(weights))) for key in keys}
        members = [settings[key] for key in keys]
        for pdf in batches:
            if pdf.empty:
                continue
            for at, x in _mapped(np.stack(pdf[features].to_numpy()), members, maps):
                for i in at:
                    y = np.where(pdf[label].to_numpy() == members[i].positive, 1.0, -1.0)
                    rows = x[(y * (x @ weights[:, keys[i]]) < 1.0) & (pdf["fold"].to_numpy() != members[i].held_out)]
                    total[keys[i]] += rows.T @ rows
        return total

    sums = _summed_products(df, len(w), [features, label, "fold"], [int(i) for i in which], task)
    shared.unpersist()
    return sums


class _Preconditioner:
    """Inverse of I + 2 C sum(x x^T) per setting; settings that see the same rows share one decomposition."""

    def __init__(self, products: dict[tuple[int, int], np.ndarray], settings: list[Setting]):
        self.c = np.array([s.c for s in settings])
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for key, product in products.items():
            self.set(np.flatnonzero([(s.kernel, s.held_out) == key for s in settings]), product)

    def set(self, at: np.ndarray, product: np.ndarray) -> None:
        values, basis = np.linalg.eigh(product)
        kept = [(np.setdiff1d(i, at), b, v[:, ~np.isin(i, at)]) for i, b, v in self.parts]
        self.parts = [p for p in kept if len(p[0])] + [(at, basis, 1.0 + 2.0 * np.maximum(values, 0.0)[:, None] * self.c[at])]

    def __call__(self, v: np.ndarray) -> np.ndarray:
        out = np.empty_like(v)
        for at, basis, scale in self.parts:
            out[:, at] = basis @ ((basis.T @ v[:, at]) / scale)
        return out


def _objective(df: DataFrame, w: np.ndarray, settings: list[Setting], features: str, label: str, bases: list[Basis]) -> tuple[np.ndarray, np.ndarray]:
    """|w|^2 / 2 + C * sum(max(0, 1 - y w.x)^2) and its gradient per setting."""
    c = np.array([s.c for s in settings])
    loss, grad = _sum_over_rows(df, w, settings, features, label, bases)
    return 0.5 * (w ** 2).sum(axis=0) + c * loss, w + c * grad


def _with_fold(df: DataFrame) -> DataFrame:
    return df if "fold" in df.columns else df.withColumn("fold", F.lit(ALL_ROWS - 1))


def gradient_ratio(df: DataFrame, weights: np.ndarray, settings: list[Setting], features: str = "features", label: str = "label",
                   bases: list[Basis] = ()) -> np.ndarray:
    """Length of the gradient at ``weights`` over that at zero, per setting: how far a fit is from its optimum."""
    df = _with_fold(df)
    at, start = (_objective(df, w, settings, features, label, list(bases))[1] for w in (weights, np.zeros_like(weights)))
    return np.linalg.norm(at, axis=0) / np.maximum(np.linalg.norm(start, axis=0), 1e-12)


def fit(df: DataFrame, settings: list[Setting], n_features: int, features: str = "features", label: str = "label",
        max_iter: int | None = None, tol: float = 1e-4, memory: int = 20, bases: list[Basis] = ()) -> np.ndarray:
    """Weights (d + 1, k) minimising |w|^2 / 2 + C * sum(max(0, 1 - y w.x)^2) for every setting.

    The constant feature (last row) is penalised like the others.  Limited-
    memory BFGS with backtracking, preconditioned by the Hessian of all rows of
    the setting, runs for all settings in step, one pass each; what QUICK passes
    leave open is done by ``_follow_penalty``, until every
    gradient is below ``tol`` times its first length.  Settings with
    a kernel see the rows through the map ``bases[kernel]``, applied in the pass;
    ``n_features`` is then the width d after the map.  The driver holds (d + 1)^2
    numbers for each kernel and held-out fold.  After MAX_ITER passes, or
    where no step helps, RuntimeError is raised; a caller who sets ``max_iter``
    gets the weights so far and a warning instead.
    """
    df = _with_fold(df)
    kept = df.storageLevel != StorageLevel.NONE
    if not kept:
        # every iteration reads all rows again
        df = df.select(features, label, "fold").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _minimise(df, settings, n_features, features, label, max_iter, tol, memory, list(bases))
    finally:
        if not kept:
            df.unpersist()


def _minimise(df: DataFrame, settings: list[Setting], n_features: int, features: str, label: str,
              max_iter: int | None, tol: float, memory: int, bases: list[Basis]) -> np.ndarray:
    def give_up(reason: str, which: np.ndarray) -> None:
        said = f"{reason}: {[settings[i] for i in which]}"
        if max_iter is None:
            raise RuntimeError(said)
        warnings.warn(said, stacklevel=4)

    w = np.zeros((n_features + 1, len(settings)))
    ready = _Preconditioner(_feature_products(df, n_features + 1, settings, features, bases), settings)
    f, g = _objective(df, w, settings, features, label, bases)
    start_norm = np.linalg.norm(g, axis=0)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    step = np.ones(len(settings))
    direction, steepest = -ready(g), np.ones(len(settings), dtype=bool)
    limit = max_iter or MAX_ITER
    for _ in range(min(limit, QUICK)):
        active = np.linalg.norm(g, axis=0) > tol * np.maximum(start_norm, 1e-12)
        if not active.any():
            return w
        slope = (g * direction).sum(axis=0)
        trial = w + np.where(active, step, 0.0) * direction
        f_new, g_new = _objective(df, trial, settings, features, label, bases)
        # the last term is what rounding does to the sum of losses
        good = active & (f_new <= f + 1e-4 * step * slope + 1e-14 * np.abs(f))
        s, y = np.where(good, trial - w, 0.0), np.where(good, g_new - g, 0.0)
        w, f, g = np.where(good, trial, w), np.where(good, f_new, f), np.where(good, g_new, g)
        # a refused step keeps its direction and is halved; the others get a new direction
        step = np.where(good, 1.0, step * 0.5)
        stuck = active & (step < 1e-12)
        if (stuck & steepest).any():
            break
        if good.any():
            past = (past + [(s, y)])[-memory:]
            direction, steepest = np.where(good, -_two_loop(g, past, ready), direction), steepest & ~good
            uphill = good & ((g * direction).sum(axis=0) >= 0)
            direction = np.where(uphill, -ready(g), direction)
        if stuck.any():
            # the pairs mislead: the preconditioned gradient alone gets a try
            direction = np.where(stuck, -ready(g), direction)
            step, steepest = np.where(stuck, 1.0, step), steepest | stuck
    left = np.flatnonzero(np.linalg.norm(g, axis=0) > tol * np.maximum(start_norm, 1e-12))
    if len(left) and limit > QUICK:
        w[:, left], open_ = _follow_penalty(df, [settings[i] for i in left], start_norm[left], n_features, features, label, limit - QUICK, tol, bases)
        left = left[open_]
    if len(left):
        give_up("not converged", left)
    return w


def _follow_penalty(df: DataFrame, settings: list[Setting], start_norm: np.ndarray, n_features: int, features: str, label: str,
                    limit: int, tol: float, bases: list[Basis]) -> tuple[np.ndarray, np.ndarray]:
    """(weights, which are still open after ``limit`` passes): Newton steps while the penalty grows to its value.

    Few rows stay within the margin under a strong penalty, and a Newton step from
    afar brings most of them back.  From the optimum of a weaker penalty the set of
    such rows changes little, so some steps lead to the next one.
    """
    full = np.array([s.c for s in settings])
    now = full / PENALTY_STEP ** np.ceil(np.log(np.maximum(full, 1.0)) / np.log(PENALTY_STEP))
    w = np.zeros((n_features + 1, len(settings)))
    loss, grad = _sum_over_rows(df, w, settings, features, label, bases)
    value = lambda v, c, sums: 0.5 * (v ** 2).sum(axis=0) + c * sums
    step, direction = np.ones(len(settings)), np.zeros_like(w)
    fresh = np.ones(len(settings), dtype=bool)
    for _ in range(limit):
        while True:
            g = w + now * grad
            near = np.linalg.norm(g, axis=0) <= tol * np.maximum(start_norm * now / full, 1e-12)
            if not (near & (now < full)).any():
                break
            now = np.where(near, np.minimum(now * PENALTY_STEP, full), now)
        if near.all():
            break
        at = np.flatnonzero(fresh & ~near)
        for k, product in _active_products(df, w, at, settings, features, label, bases).items() if len(at) else ():
            direction[:, k] = -np.linalg.solve(np.eye(len(w)) + 2.0 * now[k] * product, g[:, k])
            step[k] = 1.0
        trial = w + np.where(near, 0.0, step) * direction
        loss_new, grad_new = _sum_over_rows(df, trial, settings, features, label, bases)
        f = value(w, now, loss)
        good = ~near & (value(trial, now, loss_new) <= f + 1e-4 * step * (g * direction).sum(axis=0) + 1e-14 * np.abs(f))
        w, loss, grad = np.where(good, trial, w), np.where(good, loss_new, loss), np.where(good, grad_new, grad)
        step, fresh = np.where(good, 1.0, step * 0.5), good
    g = w + full * grad
    return w, np.linalg.norm(g, axis=0) > tol * np.maximum(start_norm, 1e-12)


def _two_loop(g: np.ndarray, past: list[tuple[np.ndarray, np.ndarray]], ready: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Inverse-Hessian product per column, starting from the preconditioner; pairs without positive curvature are skipped."""
    q, alphas = g.copy(), []
    scale = np.ones(g.shape[1])
    for s, y in reversed(past):
        sy = (s * y).sum(axis=0)
        rho = np.where(sy > 1e-300, 1.0 / np.where(sy > 1e-300, sy, 1.0), 0.0)
        a = rho * (s * q).sum(axis=0)
        q = q - a * y
        alphas.append((s, y, rho, a))
    q = ready(q)
    # the last pair that a column has says how far the preconditioner is off
    fresh = np.ones(g.shape[1], dtype=bool)
    for s, y in reversed(past):
        sy, ypy = (s * y).sum(axis=0), (y * ready(y)).sum(axis=0)
        use = fresh & (sy > 1e-300) & (ypy > 0)
        scale, fresh = np.where(use, sy / np.where(use, ypy, 1.0), scale), fresh & ~use
        if not fresh.any():
            break
    q = q * scale
    for s, y, rho, a in reversed(alphas):
        q = q + s * (a - rho * (y * q).sum(axis=0))
    return q


def held_out_scores(df: DataFrame, weights: np.ndarray, settings: list[Setting], features: str = "features",
                    label: str = "label", bases: list[Basis] = ()) -> DataFrame:
    """One row per (setting, row of its held-out fold): decision value and 0/1 truth."""
    shared = df.sparkSession.sparkContext.broadcast((weights, list(bases)))
    held = np.array([s.held_out for s in settings])
    positive = np.array([s.positive for s in settings])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, maps = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            for at, x in _mapped(np.stack(pdf[features].to_numpy()), settings, maps):
                rows, cols = np.nonzero(pdf["fold"].to_numpy()[:, None] == held[at])
                yield pd.DataFrame({"setting": at[cols].astype("int32"), "score": (x @ w[:, at])[rows, cols],
                                    "y": (pdf[label].to_numpy()[rows] == positive[at][cols]).astype("int32")})
    return df.select(features, label, "fold").mapInPandas(score, "setting int, score double, y int")


def cv_mean(per_fold: DataFrame, keys: list[str], value: str = "auc", weight: str = "n") -> DataFrame:
    """Mean over folds weighted by fold size."""
    return per_fold.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(value)) / F.sum(weight)).alias("mean_auc"))


@dataclass
class StackModel:
    """Preprocessor and one linear classifier per task, with the chosen options."""
    preprocessor: Preprocessor
    classifiers: dict[str, list[float]]
    options: dict

    def decide(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``p_m`` and ``p_k``: the sigmoid of each task's decision value."""
        ready = self.preprocessor.transform(df, features)
        for task, name in (("melanoma", "p_m"), ("keratosis", "p_k")):
            w, kernel, source = self.classifiers[task], self.options.get("kernel", {}).get(task), features
            if kernel:
                source = "_mapped"
                ready = random_fourier(ready, features, kernel["n_features"], kernel["n_out"], kernel["gamma"],
                                       kernel["seed"], source)
            ready = ready.withColumn(name, sigmoid(linear_score(source, w[:-1], w[-1]))).drop("_mapped")
        return ready

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        body = json.dumps({"preprocessor": self.preprocessor.__dict__, "classifiers": self.classifiers,
                           "options": self.options})
        spark.createDataFrame([(body,)], "model string").coalesce(1).write.mode(mode).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "StackModel":
        body = json.loads(spark.read.parquet(path).first()["model"])
        return cls(Preprocessor(**body["preprocessor"]), body["classifiers"], body["options"])


def _best_trials(per_fold: list[tuple], tasks: dict[str, int]) -> dict[str, int]:
    """Trial with the greatest fold-weighted mean AUC per task, the first one on ties."""
    best = {}
    for task in tasks:
        value: dict[int, float] = {}
        for trial in sorted({r[1] for r in per_fold if r[0] == task}):
            known = [(r[5], r[6]) for r in per_fold if r[0] == task and r[1] == trial and r[6] is not None]
            value[trial] = sum(n * a for n, a in known) / sum(n for n, _ in known) if known else -1.0
        best[task] = max(value, key=lambda t: (value[t], -t))
    return best


def _fold_results(df: DataFrame, width: int, keys: list[tuple[str, int, int]], penalty: Callable[[int], float], sizes: dict[int, int],
                  tasks: dict[str, int], max_iter: int | None, features: str, label: str, bases: list[Basis] = ()) -> list[tuple]:
    """(task, trial, fold, c, gamma, rows, auc) of every key; all keys are fitted in the same passes."""
    settings = [Setting(tasks[task], penalty(t), f, t if bases else -1) for task, t, f in keys]
    weights = fit(df, settings, width, features, label, max_iter, bases=bases)
    scored = held_out_scores(df, weights, settings, features, label, bases)
    aucs = ranking_metrics(scored, "score", "y", ["setting"])
    auc = {r["setting"]: r["auc"] for r in aucs.select("setting", "auc").collect()}      # one row per setting
    return [(task, t, f, penalty(t), None, sizes.get(f, 0), auc.get(i)) for i, (task, t, f) in enumerate(keys)]


_TRIALS = "task string, trial int, fold int, c double, gamma double, n long, auc double"


def random_search(df: DataFrame, n_features: int, trials: int = TRIALS, folds: int = FOLDS, max_iter: int | None = None,
                  seed: int = 0, features: str = "features", label: str = "label",
                  tasks: dict[str, int] = TASKS) -> tuple[DataFrame, dict[str, list[float]], dict[str, float]]:
    """(trial table, weights per task, best C per task) for rows that carry ``fold``.

    The trial with the greatest fold-weighted mean AUC wins and is refitted on
    all rows.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}    # one row per fold
        keys = [(task, t, f) for task in tasks for t in range(trials) for f in range(folds)]
        results = _fold_results(df, n_features, keys, lambda t: draw_c(t, seed), sizes, tasks, max_iter, features, label)
        best = {task: draw_c(t, seed) for task, t in _best_trials(results, tasks).items()}
        final = fit(df, [Setting(tasks[t], best[t]) for t in tasks], n_features, features, label, max_iter)
        return (df.sparkSession.createDataFrame(results, _TRIALS), {t: final[:, i].tolist() for i, t in enumerate(tasks)}, best)
    finally:
        df.unpersist()


def kernel_search(df: DataFrame, n_features: int, n_out: int, trials: int = TRIALS, folds: int = FOLDS, max_iter: int | None = None,
                  seed: int = 0, features: str = "features", label: str = "label",
                  tasks: dict[str, int] = TASKS) -> tuple[DataFrame, dict[str, list[float]], dict[str, dict]]:
    """Random search over C and gamma on random features of the Gaussian kernel.

    All trials, tasks and folds are fitted in the same passes; a pass maps the
    rows with each trial's gamma in the task, so they are kept only as they are.
    Returns the trial table, weights per task, and per task the chosen C, gamma
    and map.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r["fold"]: r["count"] for r in df.groupBy("fold").count().collect()}
        low, scale = gamma_range(sum(sizes.values()))
        gamma = [2.0 ** (low + scale * uniforms(seed, "gamma", t)[0]) for t in range(trials)]
        bases = [fourier_basis(n_features, n_out, g, seed) for g in gamma]
        keys = [(task, t, f) for task in tasks for t in range(trials) for f in range(folds)]
        found = _fold_results(df, n_out, keys, lambda t: draw_c(t, seed), sizes, tasks, max_iter, features, label, bases)
        results = [(*r[:4], gamma[r[1]], *r[5:]) for r in found]
        best = _best_trials(results, tasks)
        final = fit(df, [Setting(tasks[task], draw_c(best[task], seed), kernel=best[task]) for task in tasks], n_out, features, label, max_iter, bases=bases)
        weights = {task: final[:, i].tolist() for i, task in enumerate(tasks)}
        chosen = {task: {"c": draw_c(t, seed), "gamma": gamma[t], "n_features": n_features, "n_out": n_out, "seed": seed} for task, t in best.items()}
        return df.sparkSession.createDataFrame(results, _TRIALS), weights, chosen
    finally:
        df.unpersist()
