import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackpool.operators import joins as J
from stackpool.operators import metrics as M
from stackpool.plans import stack as K


def brute(order1, order2, truth):
    r1 = {x: i for i, x in enumerate(order1)}
    total = significant = 0
    for i in range(len(order2)):
        for j in range(i + 1, len(order2)):
            if r1[order2[i]] > r1[order2[j]]:
                total += 1
                significant += truth[order2[i]] != truth[order2[j]]
    return total, significant


def test_inversions_in_counts_strict_pairs():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v = rng.integers(0, 9, rng.integers(0, 40))
        assert M.inversions_in(v) == sum(v[i] > v[j] for i in range(len(v)) for j in range(i + 1, len(v)))


@pytest.mark.parametrize("block", [1, 13, 64, 1000, None])
def test_inversions_match_brute_force_with_ties(spark, block):
    rng = random.Random(4)
    rows = [(i, rng.choice([0.1, 0.5, rng.random()]), rng.choice([0.3, rng.random()]), rng.randint(0, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t int")
    one = M.rank_scores(df.select("id", "a"), "a", "id", "r1")
    two = M.rank_scores(df.select("id", "b", "t"), "b", "id", "r2")
    got = M.count_inversions(one.join(two, "id"), "r1", "r2", "t", block).first()
    o1 = [r[0] for r in sorted(rows, key=lambda r: r[1])]
    o2 = [r[0] for r in sorted(rows, key=lambda r: r[2])]
    assert (got["inversions"], got["significant"]) == brute(o1, o2, {r[0]: r[3] for r in rows})


def test_no_inversions_against_itself_and_all_against_the_reverse(spark):
    df = spark.range(100).select(F.col("id").alias("r1"), F.col("id").alias("r2"), (F.col("id") % 2).alias("t"))
    assert tuple(M.count_inversions(df, "r1", "r2", "t", 16).first()) == (0, 0)
    back = df.withColumn("r2", 99 - F.col("r1"))
    assert tuple(M.count_inversions(back, "r1", "r2", "t", 16).first()) == (4950, 2500)


def test_join_truth_fails_on_a_missing_image(spark):
    sub = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.1, 0.2)], "image string, p_m double, p_k double")
    truth = spark.createDataFrame([("a", 1, 0)], "image string, melanoma int, keratosis int")
    with pytest.raises(Exception, match="no truth for b"):
        J.join_truth(sub, truth).collect()


def test_evaluate_by_position_ignores_ids(spark):
    sub = spark.createDataFrame([(0, "x", 0.9, 0.1), (1, "y", 0.2, 0.8)], "line_no long, image string, p_m double, p_k double")
    truth = spark.createDataFrame([(0, "q", 1, 0), (1, "r", 0, 1)], "line_no long, image string, melanoma int, keratosis int")
    assert tuple(K.evaluate_auc(sub, truth, by_position=True).first()) == (1.0, 1.0, 1.0)


def test_confusion_matrix_keeps_zero_cells(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 0)], "t int, p int")
    got = {(r["truth"], r["prediction"]): r["n"] for r in M.confusion_matrix(df, "t", "p").collect()}
    assert got == {(a, b): {(0, 0): 1, (0, 2): 1, (1, 0): 1}.get((a, b), 0) for a in range(3) for b in range(3)}


def test_metrics_row_has_seven_columns(spark):
    rows = [(i % 3, [0.2 + 0.1 * ((i + k) % 3) for k in range(3)], i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "truth int, probabilities array<double>, prediction int")
    assert M.metrics_row(df, "truth", "c").columns == ["checkpoint", "acc", "auc1", "auc2", "map1", "map2", "isbi"]


def test_repeated_truth_gives_its_last_line_and_no_row(spark):
    from stackpool.operators import joins as J
    sub = spark.createDataFrame([("a", 0.1, 0.2), ("b", 0.3, 0.4)], "image string, p_m double, p_k double")
    truth = [("a", 0, 0, 0), ("b", 1, 0, 1), ("a", 1, 1, 2)]
    numbered = spark.createDataFrame(truth, "image string, melanoma int, keratosis int, line_no long")
    rows = {r["image"]: (r["melanoma"], r["keratosis"]) for r in J.join_truth(sub, numbered).collect()}
    assert rows == {"a": (1, 1), "b": (1, 0)} and J.join_truth(sub, numbered).count() == 2
    with pytest.raises(Exception, match="differing rows"):
        J.join_truth(sub, numbered.drop("line_no")).collect()


def test_unequal_lengths_and_unknown_ids_fail(spark):
    sub = spark.createDataFrame([("a", 0, 0.1, 0.2), ("b", 1, 0.3, 0.4)], "image string, line_no long, p_m double, p_k double")
    truth = spark.createDataFrame([("a", 0, 0, 1), ("b", 1, 1, 0), ("c", 2, 1, 0)], "image string, line_no long, melanoma int, keratosis int")
    with pytest.raises(Exception, match="no partner"):
        K.evaluate_auc(sub, truth, by_position=True).collect()
    with pytest.raises(Exception, match="not in the first"):
        K.compare_runs(sub.filter("image = 'a'"), sub, truth).collect()
    assert [r["inversions"] for r in K.compare_runs(sub, sub.filter("image = 'a'"), truth).collect()] == [0, 0]


@pytest.mark.parametrize("score", [None, float("nan")])
def test_undefined_scores_are_not_ranked(spark, score):
    rows = spark.createDataFrame([(0.5, 1), (score, 0)], "s double, y int")
    with pytest.raises(Exception, match="not a number"):
        M.ranking_metrics(rows, "s", "y").collect()


def test_inversions_on_several_levels(spark):
    import random
    rng, n = random.Random(2), 900
    second = rng.sample(range(n), n)
    rows = [(i, second[i], rng.randint(0, 2)) for i in range(n)]
    got = M.count_inversions(spark.createDataFrame(rows, "a long, b long, t int"), "a", "b", "t", block_rows=3).first()
    pairs = [(x, y) for k, x in enumerate(rows) for y in rows[:k] if y[1] > x[1]]
    assert (int(got["inversions"]), int(got["significant"])) == (len(pairs), sum(x[2] != y[2] for x, y in pairs))
