"""Feature statistics, preprocessors and the random feature map."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackpool.functions.draws import uniforms

PREPROCESS_MODES = ("PCA", "PCA_WHITEN", "Z_SCORE", "NONE")
_ARRAY = T.ArrayType(T.DoubleType())


def moments(df: DataFrame, features: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and sample variance per position, in one summarizer pass."""
    v = array_to_vector(F.col(features))
    row = df.select(v.alias("v")).agg(Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")).first()["s"]
    return int(row["count"]), row["mean"].toArray(), row["variance"].toArray()


def zscore_stats(df: DataFrame, features: str) -> DataFrame:
    """Mean and population deviation per position, as a table."""
    summary = df.select(array_to_vector(F.col(features)).alias("v")).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s"))
    both = F.arrays_zip(vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance"))
    n = F.col("s.count").cast("double")
    return summary.select(n.alias("n"), F.posexplode(both).alias("pos", "m")).select(
        "pos", F.col("m.mean").alias("mean"), F.sqrt(F.col("m.variance") * (F.col("n") - 1) / F.col("n")).alias("std"))


def matrix_apply(df: DataFrame, features: str, fn, out: str | None = None) -> DataFrame:
    """Replace a feature column by ``fn`` of the stacked batch matrix (Arrow batches)."""
    @F.pandas_udf(_ARRAY)
    def run(col: pd.Series) -> pd.Series:
        if col.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(fn(np.stack(col.to_numpy()))))
    return df.withColumn(out or features, run(F.col(features)))


@dataclass
class Preprocessor:
    """Fitted transform; ``components`` has one row per output position."""
    mode: str
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    components: list[list[float]] = field(default_factory=list)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        if self.mode == "NONE":
            return df
        if self.mode == "Z_SCORE":
            pairs = F.lit([float(v) for v in self.mean]), F.lit([float(v) for v in self.scale])
            centred = F.zip_with(F.col(features), pairs[0], lambda x, m: x - m)
            return df.withColumn(features, F.zip_with(centred, pairs[1], lambda x, s: x / s))
        mean, comps = np.array(self.mean), np.array(self.components)
        scale = np.array(self.scale)
        return matrix_apply(df, features, lambda x: (x - mean) @ comps.T / scale)

    def to_json(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        return cls(**json.loads(text))


def fit_preprocessor(df: DataFrame, mode: str, features: str = "features") -> Preprocessor:
    """Fit one of PREPROCESS_MODES; the driver receives only means and the component matrix."""
    if mode not in PREPROCESS_MODES:
        raise ValueError(f"preprocess must be one of {' '.join(PREPROCESS_MODES)}, got {mode!r}")
    if mode == "NONE":
        return Preprocessor(mode)
    n, mean, variance = moments(df, features)
    if mode == "Z_SCORE":
        std = np.sqrt(variance * (n - 1) / n)
        return Preprocessor(mode, mean.tolist(), np.where(std == 0, 1.0, std).tolist())
    vectors = df.select(array_to_vector(F.col(features)).alias("v"))
    model = PCA(k=min(len(mean), n), inputCol="v", outputCol="p").fit(vectors)
    comps = model.pc.toArray().T
    # one sign per axis: the entry of greatest size is positive
    flip = np.sign(comps[np.arange(len(comps)), np.abs(comps).argmax(axis=1)])
    comps = comps * np.where(flip == 0, 1.0, flip)[:, None]
    eigen = model.explainedVariance.toArray() * variance.sum()
    scale = np.sqrt(np.maximum(eigen, np.finfo(float).eps)) if mode == "PCA_WHITEN" else np.ones(len(comps))
    return Preprocessor(mode, mean.tolist(), scale.tolist(), comps.tolist())


def feature_sparsity(df: DataFrame, features: str) -> DataFrame:
    """Share of exact zeros per position."""
    return (df.select(F.posexplode(features).alias("pos", "x")).groupBy("pos")
            .agg(F.avg((F.col("x") == 0).cast("double")).alias("zero_share")))


def feature_histogram(df: DataFrame, features: str, low: float, width: float) -> DataFrame:
    """Row counts per (position, bin); bin b covers [low + b*width, low + (b+1)*width)."""
    return (df.select(F.posexplode(features).alias("pos", "x"))
            .groupBy("pos", F.floor((F.col("x").cast("double") - low) / width).alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def fourier_basis(n_features: int, n_out: int, gamma: float, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Directions and phases from md5 draws, so that every release of every library gives the same ones."""
    draws = np.array([uniforms(seed, "rff", i, j)[:2] for i in range(n_features) for j in range(n_out)]).reshape(n_features, n_out, 2)
    # half a step keeps the logarithm finite
    normal = np.sqrt(-2.0 * np.log(draws[..., 0] + 2.0 ** -33)) * np.cos(2 * np.pi * draws[..., 1])
    return np.sqrt(2.0 * gamma) * normal, 2 * np.pi * np.array([uniforms(seed, "phase", j)[0] for j in range(n_out)])


def fourier_map(x: np.ndarray, basis: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.sqrt(2.0 / basis[0].shape[1]) * np.cos(x @ basis[0] + basis[1])


def random_fourier(df: DataFrame, features: str, n_features: int, n_out: int, gamma: float,
                   seed: int = 0, out: str | None = None) -> DataFrame:
    """Random Fourier features of the Gaussian kernel exp(-gamma |x-y|^2) (Rahimi & Recht 2007)."""
    basis = fourier_basis(n_features, n_out, gamma, seed)
    return matrix_apply(df, features, lambda x: fourier_map(x, basis), out)
