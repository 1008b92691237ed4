"""Component scoring, stacking, final submission and evaluation, end to end."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.functions import scores as S
from stackpool.operators import images as I
from stackpool.operators import joins as J
from stackpool.operators import metrics as M
from stackpool.operators import pooling as P
from stackpool.operators import svm as V
from stackpool.operators.features import fit_preprocessor
from stackpool.operators.order import global_index
from stackpool.operators.svm import StackModel
from stackpool.session import discard, materialise
from stackpool.sources.tables import exists

SVM_METHODS = ("RBF", "LINEAR_DUAL", "LINEAR_PRIMAL")
ADD_SCORES = ("none", "probs", "logits")


def check_scoring(pool_scores: str, pool_features: str, extract: bool, add_scores: str, with_metrics: bool) -> None:
    """Refuse combinations of options that cannot work together."""
    if pool_scores not in P.SCORE_MODES:
        raise ValueError(f"pool_scores must be one of {' '.join(P.SCORE_MODES)}")
    if pool_features not in P.FEATURE_MODES:
        raise ValueError(f"pool_features must be one of {' '.join(P.FEATURE_MODES)}")
    if add_scores not in ADD_SCORES:
        raise ValueError(f"add_scores must be one of {' '.join(ADD_SCORES)}")
    if extract and with_metrics:
        raise ValueError("metrics are not computed while extracting features")
    if pool_scores == "none" and with_metrics:
        raise ValueError("metrics need pooled scores")
    if not extract and (add_scores != "none" or pool_features != "avg"):
        raise ValueError("feature options need feature extraction")
    if extract and add_scores != "none" and (pool_scores == "none") != (pool_features == "none"):
        raise ValueError("scores and features must both be pooled or both not")


def component_projection(pooled: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """Component prediction lines: id and the melanoma and keratosis scores, sorted by id."""
    return pooled.select("image", F.col(probabilities)[1].alias("p_m"), F.col(probabilities)[2].alias("p_k")).orderBy("image")


def score_component(pictures: DataFrame, model: Callable, name: str, height: int, width: int, count: int, pool: str,
                    seed: int = 0, n_classes: int = 3, **treatment) -> DataFrame:
    """Augment, score and pool: one row of probabilities and logits per image."""
    check_scoring(pool, "avg", False, "none", False)
    scored = I.score_replicas(pictures, model, n_classes, name, height, width, count, seed=seed, **treatment)
    return P.pool_scores(scored, ["image"], "logits", pool, n_classes)


@dataclass(frozen=True)
class Component:
    """One trained model of the ensemble and how its pictures are prepared."""
    name: str
    model: Callable
    treatment: str
    height: int
    width: int
    options: dict = field(default_factory=dict)


def predict_components(pictures: DataFrame, components: list[Component], folder: str, count: int, pool: str,
                       seed: int = 0, n_classes: int = 3) -> DataFrame:
    """Predictions of all components in one reading of the pictures: component, image, p_m, p_k.

    Each component's pooled lines are a table of its own below ``folder``; one that is
    there whole is not computed again, so a run that was cut off goes on with the others.
    An empty table of pictures gives empty tables.
    """
    if len({c.name for c in components}) < len(components):
        raise ValueError("component names must differ")
    check_scoring(pool, "avg", False, "none", False)
    spark = pictures.sparkSession
    path = lambda c: f"{folder.rstrip('/')}/{c.name}"
    left = [c for c in components if not exists(spark, path(c))]
    if left:
        models = {c.name: (c.model, c.treatment, c.height, c.width, c.options) for c in left}
        scored = I.score_models(pictures, models, n_classes, count, seed=seed)
        # replicas combine before the shuffle; the pooled rows are few numbers an image
        pooled = materialise(P.pool_scores(scored, ["component", "image"], "logits", pool, n_classes).select(
            "component", "image", F.col("probabilities")[1].alias("p_m"), F.col("probabilities")[2].alias("p_k")), "components")
        for c in left:
            pooled.filter(F.col("component") == c.name).drop("component").write.mode("overwrite").parquet(path(c))
        discard(pooled)
    out = None
    for c in components:
        part = spark.read.parquet(path(c)).select(F.lit(c.name).alias("component"), "image", "p_m", "p_k")
        out = part if out is None else out.unionByName(part)
    return out


def feature_component(pictures: DataFrame, model: Callable, n_features: int, name: str, height: int, width: int,
                      count: int, pool_scores: str = "avg", pool_features: str = "avg", add_scores: str = "logits",
                      seed: int = 0, n_classes: int = 3, **treatment) -> DataFrame:
    """Pooled features with the pooled scores appended.

    ``model`` returns logits followed by features in one row, so the network
    runs once per replica.
    """
    check_scoring(pool_scores, pool_features, True, add_scores, False)
    scored = I.score_replicas(pictures, model, n_classes + n_features, name, height, width, count, seed=seed,
                              out="both", **treatment)
    parts = scored.select("image", "replica", F.slice("both", 1, n_classes).alias("logits"),
                          F.slice("both", n_classes + 1, n_features).alias("features"))
    if add_scores == "none":
        return P.pool_features(parts, ["image"], "features", pool_features)
    source = {"probs": "probabilities", "logits": "logits"}[add_scores]
    both = P.pool_both(parts, ["image"], "logits", "features", pool_scores, pool_features, n_classes)
    keys = ["image", "replica"] if pool_features == "none" else ["image"]
    return both.select(*keys, S.append_scores("features", source).alias("features"))


def train_stack(rows: DataFrame, n_features: int, method: str = "RBF", preprocess: str = "PCA", trials: int = V.TRIALS,
                grouped: bool = True, key: str = "image", row_id: str | None = None, n_out: int = 512,
                max_iter: int | None = None, seed: int = 0) -> tuple[StackModel, DataFrame]:
    """(model, trial table) from rows of key, label and features.

    Folds keep the rows of one id together unless ``grouped`` is off, in which
    case they are stratified by label and ``row_id`` names a distinct row id.
    The two linear methods differ in how they were solved, not in the optimum.
    ``n_out`` is the number of random features that stand for the RBF kernel.
    """
    if method not in SVM_METHODS:
        raise ValueError(f"svm_method must be one of {' '.join(SVM_METHODS)}, got {method!r}")
    if not grouped and row_id is None:
        raise ValueError("stratified folds need a row id")
    pre = fit_preprocessor(rows, preprocess)
    width = len(pre.components) or n_features
    ready = pre.transform(rows)
    ready = V.group_folds(ready, key, seed=seed) if grouped else V.stratified_folds(ready, "label", row_id, seed=seed)
    ready = ready.select("label", "features", "fold")
    options = {"svm_method": method, "preprocess": preprocess, "trials": trials, "grouped": grouped, "seed": seed}
    if method == "RBF":
        table, weights, chosen = V.kernel_search(ready, width, n_out, trials, max_iter=max_iter, seed=seed)
        options["kernel"] = chosen
    else:
        table, weights, best = V.random_search(ready, width, trials, max_iter=max_iter, seed=seed)
        options["c"] = best
    return StackModel(pre, weights, options), table


def final_submission(features: DataFrame, model: StackModel, pool: str, key: str = "image",
                     order: list[str] | None = None) -> DataFrame:
    """Decision, sigmoid and pooling by id: one p_m, p_k row per image."""
    decided = model.decide(features)
    if pool == "none":
        return decided.select(key, "p_m", "p_k")
    order = order or [key, "comb_id"]
    if order[0] == key:
        # rows of one image are neighbours by construction, so no run has to be found
        rows = decided.withColumn("_row", F.col(order[1]) if len(order) > 1 else F.lit(0))
        return P.pool_by_id(rows, key, ["p_m", "p_k"], pool, "_row", contiguous=False)
    rows = global_index(decided, order, "_row", "pool")
    return P.pool_by_id(rows, key, ["p_m", "p_k"], pool, "_row").select(key, "p_m", "p_k")


def evaluate_auc(submission: DataFrame, truth: DataFrame, key: str = "image", by_position: bool = False) -> DataFrame:
    """One row: AUC of each task and their mean; both tasks share one pass.

    ``by_position`` pairs rows by line number instead of by id; unequal lengths
    fail the query.
    """
    if by_position:
        here, there = (d.withColumn(n, F.lit(True)) for d, n in ((submission.select("line_no", "p_m", "p_k"), "_here"),
                                                                 (truth.select("line_no", "melanoma", "keratosis"), "_there")))
        alone = F.raise_error(F.concat(F.lit("no partner for line "), F.col("line_no").cast("string")))
        joined = here.join(there, "line_no", "full_outer")
        joined = joined.withColumn("p_m", F.when(F.col("_here").isNull() | F.col("_there").isNull(), alone).otherwise(F.col("p_m")))
    else:
        joined = J.join_truth(submission, truth, key)
    tasks = joined.select(F.explode(F.array(
        F.struct(F.lit("melanoma").alias("task"), F.col("p_m").alias("score"), F.col("melanoma").alias("y")),
        F.struct(F.lit("keratosis").alias("task"), F.col("p_k").alias("score"), F.col("keratosis").alias("y")))).alias("t")).select("t.*")
    per_task = M.ranking_metrics(tasks, "score", "y", ["task"])
    wide = per_task.agg(F.max(F.when(F.col("task") == "melanoma", F.col("auc"))).alias("melanoma_auc"),
                        F.max(F.when(F.col("task") == "keratosis", F.col("auc"))).alias("keratosis_auc"))
    return wide.withColumn("average_auc", (F.col("melanoma_auc") + F.col("keratosis_auc")) / 2)


def compare_runs(first: DataFrame, second: DataFrame, truth: DataFrame, key: str = "image",
                 line_no: str = "line_no", block_rows: int | None = None) -> DataFrame:
    """Per task: rank inversions between two submissions, in all and between different truths.

    Of an id that repeats in the first submission the last line counts; an id
    that only the second one has fails the query.
    """
    out = None
    for task, score in (("melanoma", "p_m"), ("keratosis", "p_k")):
        last = first.groupBy(key).agg(F.max_by(score, line_no).alias(score), F.max(line_no).alias(line_no))
        one = M.rank_scores(last, score, line_no, "rank1").select(key, "rank1")
        two = M.rank_scores(J.join_truth(second.select(key, line_no, score), truth.select(key, task), key, (task,)),
                            score, line_no, "rank2").select(key, "rank2", task)
        unknown = F.raise_error(F.concat(F.lit("not in the first submission: "), F.col(key).cast("string")))
        both = two.join(one, key, "left").withColumn("rank1", F.coalesce("rank1", unknown))
        part = M.count_inversions(both, "rank1", "rank2", task, block_rows)
        part = part.select(F.lit(task).alias("task"), "inversions", "significant")
        out = part if out is None else out.unionByName(part)
    return out
