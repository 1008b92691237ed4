import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpool.functions import scores as S
from stackpool.operators import ensemble as E
from stackpool.operators import pooling as P
from stackpool.plans import stack as K
from stackpool.sources import tables


def replicas(spark):
    rows = [("a", 0, [1.0, -3.0, 0.5]), ("a", 1, [-1.0, 3.0, 0.25]), ("b", 0, [0.0, 0.0, 2.0]), ("b", 1, [0.5, -0.5, -2.5])]
    return spark.createDataFrame(rows, "image string, replica int, logits array<double>")


@pytest.mark.parametrize("mode", P.SCORE_MODES[:-1])
def test_pooled_average_lies_between_extremes(spark, mode):
    out = {r["image"]: r for r in P.pool_scores(replicas(spark), ["image"], "logits", mode, 3).collect()}
    assert len(out["a"]["probabilities"]) == 3
    if mode != "max":
        assert abs(sum(out["a"]["probabilities"]) - 1) < 1e-12


def test_extreme_keeps_the_first_of_equal_size(spark):
    out = {r["image"]: r["logits"] for r in P.pool_scores(replicas(spark), ["image"], "logits", "xtrm_logits", 3).collect()}
    assert out == {"a": [1.0, -3.0, 0.5], "b": [0.5, -0.5, -2.5]}


def test_feature_extreme_works_for_any_width(spark):
    df = replicas(spark).withColumn("f", F.concat("logits", "logits", "logits"))
    out = {r["image"]: r["f"] for r in P.pool_features(df, ["image"], "f", "xtrm").collect()}
    assert out["a"] == [1.0, -3.0, 0.5] * 3


def test_wide_extremes_equal_a_loop_whatever_the_batches(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 5 or None, k // 5, "t", [float(x) for x in rng.integers(-3, 4, 9)]) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, replica int, truth string, f array<float>").repartition(4)
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {k: [max((r for r in rows if r[0] == k), key=lambda r: (abs(r[3][i]), -r[1]))[3][i] for i in range(9)] for k in (None, 1, 2, 3, 4)}
    try:
        for size in ("3", most):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            out = P.pool_features(df, ["id"], "f", "xtrm", carry=["truth"])
            assert out.columns == ["id", "truth", "f"] and out.schema["f"].dataType == df.schema["f"].dataType
            assert {r["id"]: r["f"] for r in out.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    # vectors are reduced before the one shuffle, and no row is made for an element
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("MapInArrow") >= 2 and "Generate" not in text
    assert P.pool_features(df.limit(0), ["id"], "f", "xtrm").count() == 0


def test_ordered_output_is_read_back_without_a_sort(spark, tmp_path):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 37 % 1009).alias("image"), F.col("id").alias("comb_id"))
    tables.write_ordered(rows, str(tmp_path / "o"), ["image", "comb_id"])
    back = tables.read_ordered(spark, str(tmp_path / "o"))
    text = back._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in text and "Exchange hash" not in text and "Exchange range" not in text
    got = sorted((r["position"], r["image"], r["comb_id"]) for r in back.collect())
    assert got == [(k, *r) for k, r in enumerate(sorted((r["image"], r["comb_id"]) for r in rows.collect()))]
    tables.write_ordered(rows.limit(0), str(tmp_path / "none"), ["image", "comb_id"])
    assert tables.read_ordered(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("modes", [("avg", "avg"), ("max", "max"), ("xtrm_logits", "xtrm"), ("none", "none"), ("avg_logits", "xtrm")])
def test_pooling_both_equals_pooling_each(spark, modes):
    df = replicas(spark).withColumn("f", F.transform("logits", lambda x: x * 2))
    keys = ["image"] if modes[0] != "none" else ["image", "replica"]
    both = {tuple(r[k] for k in keys): (r["f"], r["probabilities"]) for r in P.pool_both(df, ["image"], "logits", "f", *modes, 3).collect()}
    f = {tuple(r[k] for k in keys): r["f"] for r in P.pool_features(df, ["image"], "f", modes[1]).collect()}
    s = {tuple(r[k] for k in keys): r["probabilities"] for r in P.pool_scores(df, ["image"], "logits", modes[0], 3).collect()}
    assert both == {k: (f[k], s[k]) for k in f}


def test_unknown_modes_are_refused(spark):
    df = replicas(spark)
    for call in (lambda: P.pool_scores(df, ["image"], "logits", "median", 3), lambda: P.pool_features(df, ["image"], "logits", "sum"),
                 lambda: P.pool_by_id(df, "image", ["replica"], "median", "replica"),
                 lambda: P.pool_both(df, ["image"], "logits", "logits", "none", "avg", 3)):
        with pytest.raises(ValueError):
            call()


def groups(spark, rows):
    return spark.createDataFrame([(i, k, i % 2, [float(i), 1.0]) for i, k in enumerate(rows)],
                                 "idx long, id string, label int, features array<double>")


def test_aggregate_replicas_takes_the_first_label(spark):
    out = sorted(P.aggregate_replicas(groups(spark, "aaabbb"), "id", "label", "features", "idx", 3).collect())
    assert [tuple(r) for r in out] == [("a", 0, 0, [1.0, 1.0]), ("b", 1, 1, [4.0, 1.0])]


@pytest.mark.parametrize("ids", ["aaab", "aabaab", "aaabb"])
def test_aggregate_replicas_refuses_broken_groups(spark, ids):
    with pytest.raises(Exception, match="contiguous records"):
        P.aggregate_replicas(groups(spark, ids), "id", "label", "features", "idx", 3).collect()


def test_aggregate_replicas_takes_short_groups_if_told(spark):
    out = sorted(P.aggregate_replicas(groups(spark, "aaabb"), "id", "label", "features", "idx", 3, short=True).collect())
    assert [tuple(r) for r in out] == [("a", 0, 0, [1.0, 1.0]), ("b", 1, 1, [3.5, 1.0])]
    with pytest.raises(Exception, match="contiguous records"):
        P.aggregate_replicas(groups(spark, "aab"), "id", "label", "features", "idx", 3, short=True).collect()


def test_aggregate_replicas_query_keeps_the_last_vectors(spark, tmp_path):
    from stackpool.queries.pools import aggregate_replicas
    rows = [(i, [float(i * (k + 1)) for k in range(64)], i % 3) for i in range(7)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r["id"], r["grp"], r["label"], r["pos"], r["x"]) for r in aggregate_replicas(spark, str(tmp_path)).collect()}
    assert got == {(g, g, first, k, mean * (k + 1)) for g, first, mean in ((0, 0, 2.0), (1, 2, 5.5)) for k in range(64)}


def test_extreme_probability_counts_certainty_as_infinite(spark):
    rows = [(0, "a", 0.5), (1, "a", 0.999), (2, "a", 0.0), (3, "a", 1.0), (4, "b", 0.25), (5, "b", 0.75), (6, "a", 0.4)]
    df = spark.createDataFrame(rows, "idx long, id string, p double")
    out = [tuple(r) for r in P.pool_by_id(df, "id", ["p"], "xtrm", "idx").orderBy("run_start").collect()]
    # equal sizes: the first row wins; the id that comes back is a run of its own
    assert out == [("a", 0, 0.0), ("b", 4, 0.25), ("a", 6, 0.4)]


def test_scalar_edges(spark):
    row = spark.range(1).select(
        S.sigmoid(F.lit(800.0)).alias("big"), S.sigmoid(F.lit(-800.0)).alias("small"), S.logit(F.lit(1.0)).alias("one"),
        S.logit(F.lit(0.0)).alias("zero"), S.bits_from_prob(F.lit(0.0)).alias("low"), S.bits_from_prob(F.lit(1.0)).alias("high"),
        S.argmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(2.0))).alias("arg"), S.normal_filename(F.lit("/x/Y.Z/Img.01.TIF")).alias("name"),
        S.file_stem(F.lit("/x/a.b.json")).alias("stem")).first()
    assert (row["big"], row["small"], row["one"], row["zero"]) == (1.0, 0.0, math.inf, -math.inf)
    assert abs(row["low"] - math.log2(0.00001 / 0.99999)) < 1e-9 and abs(row["low"] + row["high"]) < 1e-9
    assert (row["arg"], row["name"], row["stem"]) == (1, "img.01.jpg", "a")


@pytest.mark.parametrize("x", [0.0, 1.0, 0.1, 0.5, 1 / 3, 2.0 ** -17, 0.99999999999999994, -0.25, 43683.06, 1e-12, 0.07, 123456789.125])
def test_score_text_is_the_exact_value(spark, x):
    assert spark.range(1).select(S.format_score(F.lit(float(x)))).first()[0] == "%.16f" % x


def components(spark, images=("i", "j"), drop=None):
    rows = [(im, f, k, 0.1 + 0.1 * f + 0.01 * k + 0.001 * n, 0.5) for n, im in enumerate(images) for f in range(7) for k in (1, 2, 3)
            if (im, f, k) != drop]
    return spark.createDataFrame(rows, "image string, feature_set int, replica int, p_m double, p_k double")


def test_assembly_places_fourteen_features_per_combination(spark):
    out = {(r["image"], r["comb_id"]): r["features"] for r in E.assemble(components(spark), "ALL_PROBS").collect()}
    assert len(out) == 200 and len(E.ALL_COMBINATIONS) == len(set(E.ALL_COMBINATIONS)) == 100
    for c, combo in enumerate(E.ALL_COMBINATIONS):
        want = [v for f, k in enumerate(combo) for v in (0.1 + 0.1 * f + 0.01 * k + 0.001 * 1, 0.5)]
        assert out["j", c] == pytest.approx(want, abs=1e-12)


def test_assembly_fails_on_a_missing_prediction_or_label(spark):
    with pytest.raises(Exception, match="missing for j"):
        E.assemble(components(spark, drop=("j", 4, 2)), "PROBS").collect()
    labels = spark.createDataFrame([("i", 1, 0)], "image string, melanoma int, keratosis int")
    with pytest.raises(Exception, match="no label for j"):
        E.assemble(components(spark), "PROBS", labels=labels).collect()


def test_id_lists_are_compared_with_the_first(spark):
    gaps = E.check_id_lists(components(spark, drop=("j", 4, 2))).collect()
    assert [tuple(r) for r in gaps] == [(4, 2, "j", "missing")]
    extra = E.check_id_lists(components(spark, drop=("j", 0, 1))).collect()
    assert len(extra) == 20 and {r["problem"] for r in extra} == {"extra"}


@pytest.mark.parametrize("options", [
    ("median", "avg", False, "none", False), ("avg", "sum", True, "none", False), ("avg", "avg", True, "both", False),
    ("avg", "avg", True, "none", True), ("none", "avg", False, "none", True), ("avg", "max", False, "none", False),
    ("avg", "none", True, "logits", False), ("none", "avg", True, "probs", False)])
def test_impossible_scoring_options_are_refused(options):
    with pytest.raises(ValueError):
        K.check_scoring(*options)
