import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stackpool.operators import split as P
from stackpool.plans import dataset as D
from stackpool.sources import tables as T


def case_table(n=400, seed=3, hot=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.random()
        case = "hot" if hot and rng.random() < 0.34 else rng.choice([""] * 10 + [f"c{k:02d}" for k in range(26)])
        rows.append((i, f"img{i:04d}", case, int(kind < 0.2), int(0.2 <= kind < 0.35)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "line_no long, image string, case_id string, melanoma int, keratosis int")


def oracle(rows, train=85, validation=15, seed=0):
    """The rule, row by row: representatives cut per class, the rest of a case follows test, validation, train."""
    where, placed_case = {}, {}
    for stratum in ("melanoma", "keratosis", "other"):
        mine = [r for r in rows if (r[3] == 1, r[4] == 1, r[3] != 1 and r[4] != 1)[("melanoma", "keratosis", "other").index(stratum)]]
        reps, seen = [], set()
        for r in mine:
            if not r[2] or r[2] not in seen:
                reps.append(r)
                seen.add(r[2])
        reps.sort(key=lambda r: (hashlib.md5(f"{seed}:{r[1]}".encode()).hexdigest(), r[0]))
        a, b = int(len(reps) / 100.0 * train), int(len(reps) / 100.0 * validation)
        for i, r in enumerate(reps):
            split = "train" if i < a else "validation" if i < a + b else "test"
            where[r[0]] = split
            if r[2]:
                placed_case.setdefault(r[2], set()).add(split)
    for r in rows:
        if r[0] not in where:
            where[r[0]] = next(s for s in ("test", "validation", "train") if s in placed_case[r[2]])
    return where


@pytest.mark.parametrize("hot,limit,cut", [(False, 10**6, (85, 15)), (False, 3, (60, 20)), (True, 5, (85, 15)), (True, 1, (50, 25))])
def test_split_matches_the_rule(spark, hot, limit, cut):
    rows = case_table(hot=hot)
    out = P.split_dataset(frame(spark, rows), train=cut[0], validation=cut[1], rows_per_task=limit).collect()
    assert {r["line_no"]: r["split"] for r in out} == oracle(rows, *cut) and len(out) == len(rows)


def test_split_properties(spark):
    rows = P.split_dataset(frame(spark, case_table(hot=True)))
    P.require_disjoint(rows)
    # within a class, all rows of a case lie with a representative of that case
    reps = rows.groupBy("case_id", "stratum").agg(F.min_by("split", "line_no").alias("s")).filter("case_id <> ''")
    extras = rows.alias("r").join(reps.groupBy("case_id").agg(F.collect_set("s").alias("ss")), "case_id")
    assert extras.filter("not array_contains(ss, split)").count() == 0


def test_a_row_in_two_classes_trips_the_check(spark):
    rows = [(i, f"i{i}", "", 1, i % 2) for i in range(200)]
    with pytest.raises(ValueError, match="contamination"):
        D.training_rows(frame(spark, rows))


def test_contamination_ignores_the_empty_case(spark):
    df = spark.createDataFrame([("", "train"), ("", "test"), ("a", "train"), ("b", "train"), ("b", "test")], "case_id string, split string")
    assert [r["case_id"] for r in P.contaminated(df, "case_id").collect()] == ["b"]


@pytest.mark.parametrize("n", [1, 340, 341, 1024, 1024 + 340, 1024 + 341, 2048, 3072, 2500])
def test_shard_rule(spark, n):
    rows = spark.range(n).select(F.lit("test").alias("split"), F.col("id").alias("line_no"))
    got = {r["shard"]: (r["count"], r["num_shards"]) for r in P.assign_shards(rows, ["line_no"]).groupBy("shard", "num_shards").count().collect()}
    num = -(-n // 1024)
    if n % 1024 < 341:
        num = max(num - 1, 1)
    want = {s: (1024 if s < num - 1 else n - 1024 * (num - 1), num) for s in range(num)}
    assert got == want


def test_shard_names(spark):
    rows = spark.range(30).select(F.lit("train").alias("split"), F.col("id").alias("line_no"))
    names = {r[0] for r in P.assign_shards(rows, ["line_no"], per_shard=10).select("file").collect()}
    assert names == {f"skin_lesions_train_{i:05d}-of-00002" for i in (1, 2)}


def test_modes_counts_and_options(spark):
    df = frame(spark, case_table(60))
    assert {tuple(r) for r in D.test_class_counts(df).collect()} == {("melanoma", 0), ("keratosis", 0), ("other", 60)}
    black = spark.createDataFrame([("img0001",), ("",)], "image string")
    assert D.convert("TEST", df, black).count() == 59
    for call in (lambda: D.convert("BOTH", df), lambda: P.split_dataset(df, train=90, validation=20)):
        with pytest.raises(ValueError):
            call()


def test_stored_splits_are_pruned(spark, tmp_path):
    folder = str(tmp_path / "data")
    T.write_shards(D.training_rows(frame(spark, case_table(200)), per_shard=32), folder)
    df = T.read_split(spark, folder, "validation")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert df.select("split").distinct().collect()[0][0] == "validation"
    with pytest.raises(ValueError):
        T.read_split(spark, folder, "everything")
    with pytest.raises(ValueError):
        T.get_dataset(spark, "birds", "train", folder)
    assert T.get_dataset(spark, "skin_lesions", "train", folder).count() > 0


def test_shards_keep_their_order(spark, tmp_path):
    folder = str(tmp_path / "ordered")
    T.write_shards(D.training_rows(frame(spark, case_table(300)), per_shard=64), folder)
    import glob
    for d in glob.glob(f"{folder}/split=*/shard=*"):
        files = glob.glob(f"{d}/*.parquet")
        assert len(files) == 1
        pos = [r[0] for r in spark.read.parquet(files[0]).select("pos").collect()]
        assert pos == sorted(pos)


def test_work_is_skipped_when_the_target_exists(spark, tmp_path):
    path, calls = str(tmp_path / "once"), []

    def build():
        calls.append(1)
        return spark.range(5)
    assert T.write_once(spark, path, build).count() == 5
    assert T.write_once(spark, path, build).count() == 5 and len(calls) == 1


def test_feature_header_is_checked(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 0, [3.0, 4.0])], "id string, label int, features array<double>")
    T.write_features(rows, str(tmp_path / "f"), 2)
    assert T.scan_features(spark, str(tmp_path / "f")).count() == 2
    T.write_features(rows, str(tmp_path / "g"), 3)
    with pytest.raises(Exception, match="width is not 3"):
        T.scan_features(spark, str(tmp_path / "g")).collect()
    rows.limit(1).write.mode("append").parquet(str(tmp_path / "f" / "rows"))
    with pytest.raises(ValueError, match="header says 2"):
        T.scan_features(spark, str(tmp_path / "f"))


def test_picture_size_headers():
    from stackpool.queries.files import png
    assert D.picture_size(png(bytes(5 * 7 * 3), 5, 7)) == (5, 7)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc4\x00\x03x\xff\xc0\x00\x0b\x08\x01\x02\x03\x04" + b"\x00" * 8
    assert D.picture_size(jpeg) == (0x102, 0x304)
    with pytest.raises(ValueError):
        D.picture_size(b"GIF89a..........")


def test_shared_folder_comes_from_the_session(spark):
    from stackpool.session import scratch_path, shared_root
    assert shared_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_sources_that_share_line_numbers_lose_and_gain_no_row(spark):
    from stackpool.plans import metadata as G
    rows = case_table(120, seed=8)
    meta = "line_no long, image string, case_id string, melanoma int, keratosis int"
    one = spark.createDataFrame([r for r in rows if r[0] < 60], meta).withColumn("source_no", F.lit(0))
    two = spark.createDataFrame([(r[0] - 60, *r[1:]) for r in rows if r[0] >= 60], meta).withColumn("source_no", F.lit(1))
    seen = G.numbered_with_previous(one.unionByName(two), "source_no", "line_no", "image", "pos", chunk_rows=7)
    numbered = seen.drop("line_no").withColumnRenamed("pos", "line_no")
    assert {(r["line_no"], r["image"]) for r in numbered.collect()} == {(r[0], r[1]) for r in rows}
    assert [r["prev_image"] for r in seen.orderBy("pos").collect()] == [None, *[r[1] for r in rows[:-1]]]
    out = P.split_dataset(numbered).collect()
    assert len(out) == len(rows) and {r["line_no"]: r["split"] for r in out} == oracle(rows)
    # the numbers of the sources repeat, and that is refused
    with pytest.raises(ValueError, match="repeat"):
        P.split_dataset(one.unionByName(two))


def test_a_case_in_two_splits_gives_a_warning(spark):
    with pytest.warns(UserWarning, match="cases in more than one split"):
        D.training_rows(frame(spark, case_table(200)))


def test_an_unfinished_folder_is_not_a_table(spark, tmp_path):
    folder = tmp_path / "half"
    (folder / "_temporary").mkdir(parents=True)
    assert not T.exists(spark, str(folder)) and not T.exists(spark, str(tmp_path / "none"))
    assert T.write_once(spark, str(folder), lambda: spark.range(3)).count() == 3
    assert T.exists(spark, str(folder))
    assert T.write_once(spark, str(folder), lambda: spark.range(9)).count() == 3


def test_folders_do_not_grow_with_the_shards(spark, tmp_path):
    import glob
    folder = str(tmp_path / "many")
    placed = D.training_rows(frame(spark, case_table(400)), per_shard=8)
    T.write_shards(placed, folder)
    assert len(glob.glob(f"{folder}/*=*")) <= 3 and not glob.glob(f"{folder}/*/*=*")
    where = {}
    for f in glob.glob(f"{folder}/split=*/*.parquet"):
        rows = [(r["shard"], r["pos"]) for r in spark.read.parquet(f).select("shard", "pos").collect()]
        assert rows == sorted(rows)
        for shard in {s for s, _ in rows}:
            assert where.setdefault((f.split("/")[-2], shard), f) == f
    assert spark.read.parquet(folder).count() == 400
