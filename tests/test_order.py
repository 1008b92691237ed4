import random

import pytest
from pyspark.sql import functions as F

from stackpool.operators import metrics as M
from stackpool.operators import order as O
from stackpool.operators.skew import lookup_join


def letters(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aaab"), rng.choice([0.1, 0.2, 0.2, rng.random()]), rng.randint(0, 1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, s double, y int").repartition(7)


def test_global_index_is_the_sorted_position(spark):
    rows, df = letters(spark)
    got = {r["id"]: r["idx"] for r in O.global_index(df, [F.desc("s"), "id"]).collect()}
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}
    assert got == want


def test_global_index_survives_a_second_action(spark):
    _, df = letters(spark)
    indexed = O.global_index(df, ["s", "id"])
    assert sorted(r["idx"] for r in indexed.collect()) == list(range(400))
    assert sorted(map(tuple, indexed.collect())) == sorted(map(tuple, indexed.collect()))


@pytest.mark.parametrize("chunk", [1, 2, 7, 400, 1 << 20])
def test_previous_and_runs_across_chunk_borders(spark, chunk):
    rows, df = letters(spark)
    prev = {r["id"]: r["prev_k"] for r in O.with_previous(df, "id", ["k"], chunk).collect()}
    runs = {r["id"]: r["run_start"] for r in O.run_starts(df, "id", "k", chunk_rows=chunk).collect()}
    start = 0
    assert len(prev) == len(rows) == len(runs)
    for i, row in enumerate(rows):
        if i and rows[i - 1][1] != row[1]:
            start = i
        assert prev[i] == (rows[i - 1][1] if i else None)
        assert runs[i] == start


@pytest.mark.parametrize("chunk", [1, 11, 1000])
def test_running_before_matches_a_loop(spark, chunk):
    rows, df = letters(spark)
    out = O.running_before(df, ["k"], ["id"], {"best": F.max("s"), "total": F.sum("s")}, {"best": "max", "total": "sum"}, chunk)
    for r in out.collect():
        before = [q[2] for q in rows if q[1] == r["k"] and q[0] < r["id"]]
        assert r["best"] == (max(before) if before else None)
        assert (r["total"] is None) if not before else abs(r["total"] - sum(before)) < 1e-9


def pairs_auc(rows):
    pos, neg = [r[2] for r in rows if r[3]], [r[2] for r in rows if not r[3]]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def step_ap(rows, trapezoid=False):
    total, ap, tp, fp, last = sum(r[3] for r in rows), 0.0, 0, 0, 1.0
    for s in sorted({r[2] for r in rows}, reverse=True):
        hits = sum(1 for r in rows if r[2] == s and r[3])
        tp, fp = tp + hits, fp + sum(1 for r in rows if r[2] == s and not r[3])
        precision = tp / (tp + fp)
        ap += hits / total * ((precision + last) / 2 if trapezoid else precision)
        last = precision
    return ap


@pytest.mark.parametrize("buckets", [2, 3, 64])
def test_auc_and_ap_match_brute_force(spark, buckets):
    rows, df = letters(spark)
    for r in M.ranking_metrics(df, "s", "y", ["k"], buckets).collect():
        mine = [q for q in rows if q[1] == r["k"]]
        assert abs(r["auc"] - pairs_auc(mine)) < 1e-12
        assert abs(r["ap"] - step_ap(mine)) < 1e-12
        assert abs(r["ap_trapezoid"] - step_ap(mine, True)) < 1e-12


def test_auc_of_reversed_scores_is_the_complement(spark):
    _, df = letters(spark)
    a = M.ranking_metrics(df, "s", "y").first()["auc"]
    b = M.ranking_metrics(df.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    assert abs(a + b - 1) < 1e-12


def test_metrics_of_one_class_are_null(spark):
    df = spark.createDataFrame([("x", 0.1, 0), ("x", 0.2, 0), ("z", 0.1, 1)], "k string, s double, y int")
    got = {r["k"]: (r["auc"], r["ap"]) for r in M.ranking_metrics(df, "s", "y", ["k"]).collect()}
    assert got == {"x": (None, None), "z": (None, 1.0)}


def test_scores_with_one_value_for_a_third_of_the_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.rand(1)).alias("s"),
                                   (F.col("id") % 2).cast("int").alias("y"))
    plan = O.score_curve(df, "s", "y")
    # one row per distinct score: the frequent one is a single row
    assert plan.filter("score = 0.5").count() == 1
    assert plan.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == 30000


@pytest.mark.parametrize("per_task", [1, 5, 10**6])
def test_lookup_join_equals_a_plain_join_under_skew(spark, per_task):
    big = spark.range(200).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(8)], "k string, v int")
    for how in ("left", "inner"):
        a = sorted(map(tuple, lookup_join(big, small, "k", "id", how, per_task).select("id", "k", "v").collect()), key=str)
        b = sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").collect()), key=str)
        assert a == b


def test_lookup_join_spreads_a_frequent_key(spark):
    big = spark.range(100).select("id", F.lit("hot").alias("k"))
    small = spark.createDataFrame([("hot", 1)], "k string, v int")
    plan = lookup_join(big, small, "k", "id", rows_per_task=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan
