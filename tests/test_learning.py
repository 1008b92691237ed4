import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpool.operators import features as X
from stackpool.operators import svm as V
from stackpool.plans import stack as K


def blobs(spark, n=240, d=5, seed=0):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    x = rng.normal(size=(n, d)) + label[:, None] * np.linspace(-0.6, 0.6, d)
    rows = [(int(i // 4), int(i), int(label[i]), x[i].tolist()) for i in range(n)]
    return x, label, spark.createDataFrame(rows, "id int, row int, label int, features array<double>").repartition(5)


def newton(x, label, positive, c):
    x = np.hstack([x, np.ones((len(x), 1))])
    y, w = np.where(label == positive, 1.0, -1.0), np.zeros(x.shape[1])
    for _ in range(200):
        m = 1 - y * (x @ w)
        a = m > 0
        g = w - 2 * c * x[a].T @ (y[a] * m[a])
        h = np.eye(len(w)) + 2 * c * x[a].T @ x[a]
        w = w - 0.5 * np.linalg.solve(h, g)
    return w


def test_fit_reaches_the_optimum_of_every_setting(spark):
    x, label, df = blobs(spark)
    settings = [V.Setting(p, c) for p in (1, 2) for c in (2.0 ** -10, 0.5, 2.0 ** 8)]
    w = V.fit(df, settings, 5, max_iter=100, tol=1e-7)
    for i, s in enumerate(settings):
        best = newton(x, label, s.positive, s.c)
        assert np.abs(w[:, i] - best).max() < 1e-3 * max(1, np.abs(best).max())


def test_strong_penalties_and_kernel_maps_converge_in_few_passes(spark, monkeypatch, recwarn):
    x, label, df = blobs(spark)
    bases = [X.fourier_basis(5, 96, g, 0) for g in (0.001, 0.3)]
    settings = [V.Setting(p, c, h, k) for p, h in ((1, V.ALL_ROWS), (2, 1)) for c in (2.0 ** -16, 2.0 ** 16) for k in (0, 1)]
    folded = V.group_folds(df, "id")
    passes, once = [], V._sum_over_rows
    monkeypatch.setattr(V, "_sum_over_rows", lambda *a, **k: passes.append(1) or once(*a, **k))
    # four sums, so that one pass does not hold them
    monkeypatch.setattr(V, "PRODUCT_BYTES", 8 * 97 * 98 // 2 * 3)
    w = V.fit(folded, settings, 96, bases=bases)
    assert len(passes) < 120 and not [r for r in recwarn if "converged" in str(r.message)]
    fold = {r["row"]: r["fold"] for r in folded.select("row", "fold").collect()}
    for i, s in enumerate(settings):
        keep = np.array([fold[j] != s.held_out for j in range(len(x))])
        z = np.hstack([X.fourier_map(x, bases[s.kernel]), np.ones((len(x), 1))])[keep]
        y = np.where(label[keep] == s.positive, 1.0, -1.0)
        value = lambda v: 0.5 * v @ v + s.c * (np.maximum(0, 1 - y * (z @ v)) ** 2).sum()
        best = newton(z[:, :-1], label[keep], s.positive, s.c)
        assert value(w[:, i]) <= value(best) * (1 + 1e-4)


def test_held_out_rows_do_not_influence_a_fit(spark):
    x, label, df = blobs(spark)
    folded = V.group_folds(df, "id")
    w = V.fit(folded, [V.Setting(1, 0.5, 2)], 5, tol=1e-7)
    fold = {r["row"]: r["fold"] for r in folded.select("row", "fold").collect()}
    keep = np.array([fold[i] != 2 for i in range(len(x))])
    assert np.abs(w[:, 0] - newton(x[keep], label[keep], 1, 0.5)).max() < 1e-3
    held = V.held_out_scores(folded, w, [V.Setting(1, 0.5, 2)])
    assert held.count() == int((~keep).sum())


def test_many_partial_sums_are_added_in_two_levels(spark):
    x, label, df = blobs(spark)
    few = V.fit(df.coalesce(1), [V.Setting(1, 0.5)], 5, max_iter=3)
    many = V.fit(df.repartition(V.FAN_IN + 8), [V.Setting(1, 0.5)], 5, max_iter=3)
    assert np.allclose(few, many)


@pytest.mark.parametrize("method", ["hash", "balanced"])
def test_no_id_is_in_two_folds(spark, method):
    _, _, df = blobs(spark)
    folded = V.group_folds(df, "id", method=method)
    assert folded.groupBy("id").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert sum(sizes) == 240 and (method == "hash" or max(sizes) - min(sizes) <= 4)


def test_stratified_folds_are_even(spark):
    _, label, df = blobs(spark)
    for r in V.stratified_folds(df, "label", "row").groupBy("label", "fold").count().collect():
        assert abs(r["count"] - (label == r["label"]).sum() / 3) <= 1


def test_search_picks_the_best_weighted_mean_and_refits(spark):
    x, label, df = blobs(spark)
    table, weights, best = V.random_search(V.group_folds(df, "id"), 5, trials=4, max_iter=40)
    assert table.count() == 2 * 4 * 3
    for task, positive in V.TASKS.items():
        means = {}
        for r in table.filter(F.col("task") == task).collect():
            means.setdefault(r["trial"], []).append((r["n"], r["auc"]))
        value = {t: sum(n * a for n, a in v) / sum(n for n, _ in v) for t, v in means.items()}
        top = max(value, key=lambda t: (value[t], -t))
        assert best[task] == V.draw_c(top)
        assert np.abs(np.array(weights[task]) - newton(x, label, positive, best[task])).max() < 0.05 * np.abs(weights[task]).max()


def test_trial_draws(spark):
    low, scale = V.gamma_range(1000)
    assert low == np.floor(np.log2(1 / 1000)) - 4 and low + scale == 3.0
    assert V.gamma_range(2 ** 60)[1] == 32.0
    got = {r["trial"]: r for r in V.trial_table(spark, 20, 1000).collect()}
    assert all(abs(got[t]["c"] / V.draw_c(t) - 1) < 1e-12 for t in got)
    assert all(2.0 ** -16 <= r["c"] <= 2.0 ** 16 and 2.0 ** low <= r["gamma"] <= 8 for r in got.values())


@pytest.mark.parametrize("mode", X.PREPROCESS_MODES)
def test_preprocessors_match_numpy(spark, mode):
    x, _, df = blobs(spark)
    x = x @ np.diag([1, 5, 0.3, 2, 1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row int, features array<double>")
    pre = X.fit_preprocessor(df, mode)
    out = X.Preprocessor.from_json(pre.to_json()).transform(df)
    got = np.array([r["features"] for r in out.orderBy("row").collect()])
    if mode == "NONE":
        assert np.allclose(got, x)
    elif mode == "Z_SCORE":
        assert np.allclose(got, (x - x.mean(0)) / x.std(0))
    else:
        value, vector = np.linalg.eigh(np.cov(x.T))
        want = (x - x.mean(0)) @ vector[:, ::-1]
        if mode == "PCA_WHITEN":
            want = want / np.sqrt(value[::-1])
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_constant_feature_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "features array<double>")
    got = sorted(r[0] for r in X.fit_preprocessor(df, "Z_SCORE").transform(df).collect())
    assert got == [[0.0, -1.0], [0.0, 1.0]]
    with pytest.raises(ValueError):
        X.fit_preprocessor(df, "LDA")


def test_random_features_approximate_the_kernel(spark):
    x, _, df = blobs(spark, n=40)
    out = X.random_fourier(df, "features", 5, 4000, 0.2)
    z = np.array([r["features"] for r in out.orderBy("row").collect()])
    d2 = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-0.2 * d2)).max() < 0.1


def test_model_survives_a_round_trip(spark, tmp_path):
    _, _, df = blobs(spark)
    pre = X.fit_preprocessor(df, "PCA")
    model = V.StackModel(pre, {"melanoma": [0.1] * 6, "keratosis": [-0.2] * 6}, {"preprocess": "PCA"})
    model.save(spark, str(tmp_path / "model"))
    again = V.StackModel.load(spark, str(tmp_path / "model"))
    assert again.options == model.options
    a = model.decide(df).orderBy("row").select("p_m", "p_k").collect()
    b = again.decide(df).orderBy("row").select("p_m", "p_k").collect()
    assert np.allclose(a, b)


@pytest.mark.parametrize("pool", ["none", "avg", "max", "xtrm"])
def test_final_submission_pools_by_image(spark, pool):
    rows = [("a", 0, [0.0, 1.0]), ("a", 1, [0.0, -2.0]), ("b", 0, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "image string, comb_id int, features array<double>")
    model = V.StackModel(X.Preprocessor("NONE"), {"melanoma": [1.0, 1.0, 0.0], "keratosis": [0.0, 1.0, 0.5]}, {})
    s = lambda v: 1 / (1 + np.exp(-v))
    m, k = {"a": [s(1), s(-2)], "b": [s(3)]}, {"a": [s(1.5), s(-1.5)], "b": [s(0.5)]}
    pick = {"avg": np.mean, "max": max, "xtrm": lambda v: max(v, key=lambda p: abs(np.log(p / (1 - p))))}
    for order in (["image", "comb_id"], ["comb_id"]):
        if pool == "none":
            assert K.final_submission(df, model, pool, order=order).count() == 3
        elif order[0] == "image":
            got = {r["image"]: (r["p_m"], r["p_k"]) for r in K.final_submission(df, model, pool).collect()}
            assert got["a"][0] == pytest.approx(pick[pool](m["a"])) and got["b"] == pytest.approx((m["b"][0], k["b"][0]))


def rings(spark, n=600):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    label = np.where((x ** 2).sum(1) < 0.8, 1, np.where((x ** 2).sum(1) > 2.5, 2, 0))
    rows = [(f"i{i // 2}", i, int(label[i]), x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "image string, row int, label int, features array<double>")


@pytest.mark.parametrize("method,preprocess,low,high", [("RBF", "Z_SCORE", 0.95, 1.0), ("LINEAR_DUAL", "PCA", 0.0, 0.75)])
def test_training_end_to_end(spark, tmp_path, method, preprocess, low, high):
    df = rings(spark)
    model, table = K.train_stack(df, 2, method, preprocess, trials=4, n_out=128, max_iter=40)
    best = table.filter("task = 'melanoma'").groupBy("trial").agg(F.sum(F.col("n") * F.col("auc")) / F.sum("n")).collect()
    assert low <= max(r[1] for r in best) <= high
    model.save(spark, str(tmp_path / "m"))
    again = V.StackModel.load(spark, str(tmp_path / "m")).decide(df).orderBy("row").select("p_m", "p_k").collect()
    assert np.allclose(again, model.decide(df).orderBy("row").select("p_m", "p_k").collect())


def test_training_options_are_checked(spark):
    df = rings(spark, 20)
    for options in ({"method": "POLY"}, {"preprocess": "LDA"}, {"grouped": False}):
        with pytest.raises(ValueError):
            K.train_stack(df, 2, **{"method": "LINEAR_DUAL", "preprocess": "NONE", **options})
    model, table = K.train_stack(rings(spark, 90), 2, "LINEAR_PRIMAL", "NONE", trials=1, grouped=False, row_id="row", max_iter=3)
    assert table.count() == 6 and set(model.classifiers) == {"melanoma", "keratosis"}


def test_rbf_query_searches_with_the_defaults(monkeypatch):
    import inspect
    from stackpool.queries import learning as L
    asked = []

    class Stop(Exception):
        pass

    def train(*args, **options):
        asked.append(inspect.signature(original).bind(*args, **options))
        asked[0].apply_defaults()
        raise Stop
    original = K.train_stack
    monkeypatch.setattr(L, "_meta_rows", lambda spark, sf: None)
    monkeypatch.setattr(L.K, "train_stack", train)
    with pytest.raises(Stop):
        L.train_stack_rbf(None, "")
    assert (asked[0].arguments["trials"], asked[0].arguments["n_out"]) == (10, 512)
