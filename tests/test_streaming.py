import os

from pyspark.sql import functions as F

from stackpool.streaming import selection as L

SCHEMA = "model string, checkpoint string, seq long, score double"


def test_margin_and_empty_scores_in_a_batch(spark):
    rows = [("m", "c1", 1, 0.5), ("m", "c2", 2, 0.5004), ("m", "c3", 3, 0.6), ("m", "c4", 4, 0.55), ("m", "c5", 5, None), ("n", "c1", 1, None), ("n", "c2", 2, 0.1)]
    out = L.improvements(spark.createDataFrame(rows, SCHEMA)).orderBy("model", "seq").collect()
    assert [r["improved"] for r in out] == [True, False, True, False, False, False, True]
    assert [r["best_before"] for r in out] == [0.0, 0.5, 0.5004, 0.6, 0.6, 0.0, 0.0]


def test_stream_continues_from_its_state(spark, tmp_path):
    source, log, state, best = (str(tmp_path / n) for n in ("in", "log", "state", "best"))
    batches = [[("m", "c1", 1, 0.5)], [("m", "c2", 2, 0.5004), ("m", "c3", 3, 0.6)], [("m", "c5", 5, None), ("m", "c4", 4, 0.55), ("n", "d1", 1, 0.2)]]
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        job = L.run_selection(spark, source, log, state, best, evaluate=lambda df, i: seen.append((i, df.count())))
        job.awaitTermination()
    out = spark.read.parquet(log).orderBy("model", "seq").collect()
    assert [(r["checkpoint"], r["improved"]) for r in out] == [("c1", True), ("c2", False), ("c3", True), ("c4", False), ("c5", False), ("d1", True)]
    last = spark.read.parquet(f"{best}/v=2")
    assert {(r["model"], r["checkpoint"]) for r in last.collect()} == {("m", "c3"), ("n", "d1")}
    assert [n for _, n in seen] == [1, 2, 3]


def test_batch_and_stream_agree(spark, tmp_path):
    log = spark.range(300).select((F.col("id") % 3).cast("string").alias("model"), F.concat(F.lit("c"), "id").alias("checkpoint"),
                                  F.col("id").alias("seq"), F.rand(1).alias("score"))
    log.repartition("model").sortWithinPartitions("seq").write.parquet(str(tmp_path / "in"))
    L.run_selection(spark, str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "state")).awaitTermination()
    cols = ["model", "seq", "best_before", "improved"]
    a = sorted(map(tuple, spark.read.parquet(str(tmp_path / "log")).select(cols).collect()))
    b = sorted(map(tuple, L.improvements(spark.read.parquet(str(tmp_path / "in"))).select(cols).collect()))
    assert a == b and len(a) == 300


def test_newest_checkpoint_and_best(spark):
    files = spark.createDataFrame([("m", "a", 1), ("m", "c", 3), ("m", "b", 3)], "model string, path string, t int")
    assert L.latest(files, ["model"], "path", "t").first()["path"] == "c"
    assert L.best_score(files.withColumn("score", F.col("t") * 1.0)).first()["best"] == 3.0


def test_checkpoints_of_many_folders_are_seen_once(spark, tmp_path):
    folders, seen, state = [tmp_path / "a", tmp_path / "b"], str(tmp_path / "seen"), str(tmp_path / "state")

    def put(folder, *names):
        folder.mkdir(exist_ok=True)
        for n in names:
            (folder / n).write_bytes(n.encode())

    put(folders[0], *(f"m.ckpt-{i}.index" for i in range(5)), "m.ckpt-1.data", "m.ckpt-x.index", "other.index")
    put(folders[1], "m.ckpt-7.index", "notes")
    for late in ((), ("m.ckpt-9.index", "m.ckpt-9.data")):
        put(folders[1], *late)
        L.run_checkpoints(spark, [str(f) for f in folders], seen, state, max_files=2)
    want = [f"m.ckpt-{i}.index" for i in (0, 1, 2, 3, 4, 7, 9)]
    assert sorted((r["name"], r["length"]) for r in spark.read.parquet(seen).collect()) == [(n, len(n)) for n in want]
    # the setting of the streams does not stay
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"


def test_checkpoints_query_keeps_folders_small(spark, tmp_path, monkeypatch):
    from stackpool.queries import files
    from stackpool.queries.evaluation import stream_checkpoints
    monkeypatch.setattr(files.files_in_folders, "__defaults__", (16,))
    made = []
    whole = files.one_file_each
    monkeypatch.setattr(files, "one_file_each", lambda *a: made.append(whole(*a)) or made[-1])
    spark.range(50).selectExpr("id as doc_id", "repeat('x', cast(id % 3 + 1 as int)) as lang", "'s' as source").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, stream_checkpoints(spark, str(tmp_path)).collect()))
    assert got == sorted((f"model.ckpt-{i}.index", i % 3 + 1) for i in range(50))
    sizes = [len(names) for _, _, names in os.walk(made[0])]
    assert sum(sizes) == 100 and sizes[0] == 0 and max(sizes) <= 40


def test_checkpoint_streams_run_together_and_list_in_few_tasks(spark, tmp_path, monkeypatch):
    import pytest
    folders, seen, state = [str(tmp_path / f"f{k}") for k in range(5)], str(tmp_path / "seen"), str(tmp_path / "state")
    for k, folder in enumerate(folders):
        os.mkdir(folder)
        for i in range(40):
            with open(f"{folder}/m{k}.ckpt-{i}.index", "w") as f:
                f.write("x")
    sessions, whole = [], L.checkpoint_stream
    monkeypatch.setattr(L, "checkpoint_stream", lambda s, *a, **k: sessions.append(s) or whole(s, *a, **k))
    L.run_checkpoints(spark, folders, seen, state, together=2)
    assert spark.read.parquet(seen).select("name").distinct().count() == 200
    tasks = str(spark.sparkContext.defaultParallelism)
    assert {s.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") for s in sessions} == {tasks}
    assert {s.conf.get("spark.sql.shuffle.partitions") for s in sessions} == {spark.conf.get("spark.sql.shuffle.partitions")}
    # a stream that fails ends the others
    with pytest.raises(Exception, match="nowhere"):
        L.run_checkpoints(spark, [*folders[:1], str(tmp_path / "nowhere"), *folders[1:]], seen, state)
    assert not any(s.streams.active for s in sessions)


def test_a_folder_is_written_by_one_task(spark, monkeypatch):
    from stackpool.queries import files
    placed, whole = [], files.one_file_each
    monkeypatch.setattr(files, "one_file_each", lambda df, *a: placed.append(df) or whole(df, *a))
    rows = spark.range(0, 300, 1, 6).selectExpr("concat('n', id) as name", "cast('x' as binary) as content")
    folders = files.files_in_folders(rows.unionByName(rows.limit(1).withColumn("name", F.lit(None))), "t", 40)
    at = placed[0].select(F.substring_index("name", "/", 1).alias("at"), F.spark_partition_id().alias("task")).distinct().collect()
    assert len(folders) == 8 and len(at) == len({r["at"] for r in at}) == 8
    found = [n for f in folders for n in os.listdir(f.removeprefix("file://"))]
    assert sorted(found) == sorted(["None", *(f"n{i}" for i in range(300))])


def test_a_hot_model_is_spread_over_chunks(spark, tmp_path, monkeypatch):
    from stackpool.operators import order
    monkeypatch.setattr(order.running_before, "__defaults__", (64,))
    rows = [("hot" if i % 3 else f"m{i % 5}", f"c{i}", i, None if i % 11 == 0 else (i * 37 % 101) / 50) for i in range(900)]
    one, two = (spark.createDataFrame([r for r in rows if lo <= r[2] < hi], SCHEMA) for lo, hi in ((0, 500), (500, 900)))
    known = L.advanced(one, None).groupBy("model").agg(F.max("score").alias("best"))
    got = L.advanced(one, None).unionByName(L.advanced(two, known))
    want = L.improvements(spark.createDataFrame(rows, SCHEMA))
    cols = ["model", "seq", "best_before", "improved"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in text and "Python" not in text


PREDICTIONS = "model string, truth int, prediction int, probabilities array<double>"


def predictions(n, seed):
    import random
    rng = random.Random(seed)
    out = []
    for i in range(n):
        p = [rng.randint(0, 9) / 10 for _ in range(3)]
        out.append(("a" if rng.random() < 0.7 else "b", rng.randrange(3), max(range(3), key=p.__getitem__), p))
    return out


def test_metrics_follow_the_stream_without_reading_again(spark, tmp_path):
    from stackpool.operators import metrics as M
    source, folder, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [predictions(40, 1), predictions(25, 2), [("c", 1, 1, [0.1, 0.8, 0.1])]]
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, PREDICTIONS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PREDICTIONS).parquet(source)
        L.run_evaluation(spark, stream, folder, state).awaitTermination()
        so_far = [r for part in parts[:k + 1] for r in part]
        got = {r["model"]: r for r in spark.read.parquet(f"{folder}/metrics/batch={k}").collect()}
        assert set(got) == {r[0] for r in rows}
        for model, r in got.items():
            mine = spark.createDataFrame([x for x in so_far if x[0] == model], PREDICTIONS)
            want = M.metrics_row(mine, "truth", "x").first()
            assert r["n"] == mine.count()
            for c in ("acc", "auc1", "auc2", "map1", "map2", "isbi"):
                assert (r[c] is None) == (want[c] is None) and (r[c] is None or abs(r[c] - want[c]) < 1e-12)
    # one model of one class: undefined metrics are null; two versions of the counts stay
    assert got["c"]["auc1"] is None
    assert sorted(p.name for p in (tmp_path / "out" / "scores").iterdir()) == ["v=1", "v=2"]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("m", "c1", 1, 0.5), ("m", "c2", 2, 0.7)], SCHEMA)
    folder = str(tmp_path / "state")
    for _ in range(2):
        L._leave(rows.groupBy("model").agg(F.max("score").alias("best")), folder, 0)
    for _ in range(2):
        known = L._version(spark, folder, 1)
        again = L.advanced(spark.createDataFrame([("m", "c3", 3, 0.7005)], SCHEMA), known).collect()
        assert [(r["best_before"], r["improved"]) for r in again] == [(0.7, False)]
        L._leave(known, folder, 1)
