"""Quality classifier by positive-unlabelled learning.

A linear model on byte, byte-pair and word statistics of whole texts minimises the
non-negative unbiased risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))
of trusted positives p and unlabelled documents u; where the second term falls
below zero, a step goes back on it.  It is fitted on a bounded sample of both, by
least hash of the key.  The class prior is estimated from the same two samples and
needs no negative label: at a threshold above which a share a of the positives and
b of the unlabelled rows lies, b / a bounds it, and the bound is near where few
negatives score as high.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.llm.common import id_crc, id_text, slices, words_of

#: Rows that the model is fitted on, at most.
POSITIVES, UNLABELLED = 4096, 8192
STEPS, RATE, WEIGHT_DECAY = 300, 0.05, 1e-2
PAIR_BINS = 512
#: Bytes of text that are counted at a time.
SLICE = 1 << 20
N_FEATURES = 256 + PAIR_BINS + 8


def features(texts: pa.Array) -> np.ndarray:
    """A row of N_FEATURES numbers for each text; all of the text counts."""
    raw = texts.cast(pa.binary())
    sizes = pa.compute.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(sizes)
    data = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(n), sizes)
    single = np.bincount(owner * 256 + data, minlength=n * 256).reshape(n, 256).astype(np.float64)
    same = owner[1:] == owner[:-1]
    pair = ((data[:-1] * 40503 + data[1:] * 30011) >> 5) % PAIR_BINS
    double = np.bincount((owner[1:] * PAIR_BINS + pair)[same], minlength=n * PAIR_BINS).reshape(n, PAIR_BINS).astype(np.float64)
    which, words, many = words_of(texts)
    at = np.repeat(np.arange(n), many)
    code = at * max(len(words), 1) + which
    distinct = np.bincount(np.unique(code) // max(len(words), 1), minlength=n)
    again = np.bincount(at[1:][(which[1:] == which[:-1]) & (at[1:] == at[:-1])], minlength=n)
    per = lambda x, y: x / np.maximum(y, 1)
    digit, upper, lower = single[:, 48:58].sum(axis=1), single[:, 65:91].sum(axis=1), single[:, 97:123].sum(axis=1)
    shape = np.stack([np.log1p(sizes), np.log1p(many), per(distinct, many), per(again, many), np.log1p(per(sizes - many, many) / 10), per(digit, sizes),
                      per(upper, upper + lower), np.log1p(per(single[:, 10], many))], axis=1)
    # roots of shares: rare signs count too
    return np.concatenate([np.sqrt(single / np.maximum(sizes, 1)[:, None]), np.sqrt(double / np.maximum(sizes, 1)[:, None]), shape], axis=1)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def scores(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = WEIGHT_DECAY) -> Model:
    """Minimise the non-negative risk with the logistic loss, all rows in each step."""
    if not len(positive) or not len(unlabelled):
        # nothing to learn from: every text gets the prior
        d = N_FEATURES
        return Model(np.zeros(d), np.ones(d), np.zeros(d), float(np.log(prior / (1 - prior))))
    return _descend(np.concatenate([positive, unlabelled], dtype=np.float32), len(positive), prior, steps, rate, decay)


def _descend(both: np.ndarray, many: int, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = WEIGHT_DECAY) -> Model:
    """``fit`` of rows whose first ``many`` are the positives; scales ``both`` in place, no second copy stands beside it."""
    mean = both.mean(axis=0, dtype=np.float64)
    # some columns at a time: squares are as wide as doubles
    scale = np.concatenate([both[:, at:at + 64].std(axis=0, dtype=np.float64) for at in range(0, both.shape[1], 64)]) + 1e-3
    both -= mean.astype(np.float32)
    both /= scale.astype(np.float32)
    p, u = np.split(np.clip(both, -8, 8, out=both), [many])
    w, b = np.zeros(p.shape[1], dtype=np.float32), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    loss = lambda z: np.logaddexp(0, -z)
    for t in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        rest = loss(-zu).mean() - prior * loss(-zp).mean()
        # derivatives of the two parts by the scores
        gp, gu = -prior * sigmoid(-zp) / len(p), np.zeros(len(u))
        if rest >= 0:
            gp, gu = gp - prior * sigmoid(zp) / len(p), sigmoid(zu) / len(u)
        else:
            gp, gu = prior * sigmoid(zp) / len(p), -sigmoid(zu) / len(u)
        g = np.append(p.T @ gp.astype(np.float32) + u.T @ gu.astype(np.float32) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), b - float(step[-1])
    return Model(mean, scale, w.astype(np.float64), b)


#: Parts of the samples that the prior is estimated on in turn, by models of the others; and chance that sampling errors of a bound are larger than allowed for.
FOLDS, DELTA = 4, 0.1


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = FOLDS, delta: float = DELTA) -> float:
    """Share of positives among the unlabelled rows, kept within 0.01 and 0.99; 0.5 where a fold would be empty.

    Every row is scored by a model that did not see its fold.  Of all thresholds
    the one counts whose bound, sampling errors added, is least.
    """
    if min(len(positive), len(unlabelled)) < folds:
        return 0.5
    scored = [np.zeros(len(rows)) for rows in (positive, unlabelled)]
    for fold in range(folds):
        mine = [np.arange(len(rows)) % folds == fold for rows in (positive, unlabelled)]
        others = np.concatenate([positive[~mine[0]], unlabelled[~mine[1]]], dtype=np.float32)
        model = _descend(others, int((~mine[0]).sum()), 0.5)
        del others
        for rows, at, out in zip((positive, unlabelled), mine, scored):
            out[at] = model.scores(rows[at])
    p, u = (np.sort(x) for x in scored)
    above_p = (len(p) - np.searchsorted(p, p)) / len(p)
    above_u = (len(u) - np.searchsorted(u, p)) / len(u)
    error = np.sqrt(np.log(4 / delta) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = int(np.argmin((above_u + error) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def _featured(rows: DataFrame) -> DataFrame:
    """(positive, features as bytes of 32-bit numbers) of (doc_id, text, positive) rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                found = features(batch.column(1)[a:b]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(2)[a:b], pa.array([r.tobytes() for r in found], pa.binary())], ["positive", "features"])
    return rows.mapInArrow(run, "positive boolean, features binary")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, seed: int = 11) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), both of the training fold.

    Trusted positives are documents of quality 1; other labels are not read.
    Unlabelled rows are drawn from all documents, whatever their labels.
    """
    judged = labels.filter("doc_id is not null and quality = 1").select("doc_id").distinct()
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    ids = docs.select("doc_id").filter("doc_id is not null")
    good = judged.join(ids.distinct(), "doc_id").orderBy(*order).limit(positives).withColumn("positive", F.lit(True))
    some = ids.distinct().orderBy(*order).limit(unlabelled).withColumn("positive", F.lit(False))
    # at most positives + unlabelled keys
    chosen = F.broadcast(good.unionByName(some))
    taken = _featured(docs.join(chosen, "doc_id").select("doc_id", "text", "positive")).toArrow()
    sides = []
    for wanted in (True, False):
        found = taken.filter(pa.compute.equal(taken["positive"], wanted))["features"]
        rows = np.empty((len(found), N_FEATURES), dtype=np.float32)
        for i, row in enumerate(found):
            rows[i] = np.frombuffer(row.as_buffer(), dtype=np.float32)
        # in an order of their own, whatever tasks sent them: that of their bytes, then shuffled
        order = np.argsort(rows.view(f"S{4 * N_FEATURES}").ravel())
        sides.append(rows[order[np.random.default_rng(seed).permutation(len(rows))]])
        del found, rows
    # the driver's memory is bounded: what the tasks sent goes before the fits
    del taken
    pa.default_memory_pool().release_unused()
    return fit(*sides, estimate_prior(*sides))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; the whole text counts, an empty or null text too."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(held.value.scores(features(batch.column(1)[a:b])))], ["doc_id", "score"])
    return docs.mapInArrow(run, "doc_id long, score double")


def train_fold(id_col: str = "doc_id"):
    """Rows whose labels may be learnt from."""
    return id_crc(id_col) % 3 != 1


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns from the training fold alone.  Rows of one doc_id and text score alike.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = train(rows.filter(train_fold()), judged.filter(train_fold()))
    out = score(rows, model)
    return out.select("doc_id", (~train_fold()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that ``classify`` predicts 1 for; the text does not leave its task."""
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    judged = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    held = docs.sparkSession.sparkContext.broadcast(train(rows.filter(train_fold()), judged.filter(train_fold())))

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        found = pa.array(texts.fillna(""), pa.string())
        parts = [held.value.scores(features(found[a:b])) >= 0.5 for a, b in slices(found, SLICE)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0, dtype=bool))
    return docs.filter(good(F.col(text_col).cast("string")))
