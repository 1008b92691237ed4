import os

import pytest

from stackpool import schemas
from stackpool import session as S
from stackpool.operators import normalise as N
from stackpool.plans import metadata as G
from stackpool.sources import text as T


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sources")
    atlas = "type\timage\tcase\tx\tmel\tker\tage\thas\tsex\thas\tsched\tw\n" + \
        "Dermo\tA1\tnel026\t-\t1\t0\t44\t1\tfemale\t1\t2\t3\nClinic\tA1\tnel026\t-\t1\t0\t44\t1\tfemale\t1\t2\t3\n" + \
        "Dermo\tA2\tb1\t-\t0\t1\t50\t0\tmale\t0\t1\t1.5\nDermo\tA1\tb1\t-\t0\t1\t50\t0\tmale\t0\t1\t1\nDermo\tNOFILE\tb1\t-\t0\t1\t50\t0\tmale\t0\t1\t1\n" + \
        "Dermo\tA1\tb1\t-\t0\t1\t50\t0\tmale\t0\t1\t1\n"
    archive = "image, benign, diagnosis, confirm, age, sex\n" + \
        "I1, benign, melanoma, histopathology, 30, male\nI2, None, other, None, None, None\nI3, None, None, None, 20, None\n" + \
        "I4, benign, nevus, single image expert consensus, 15, female\nI5, x, seborrheic keratosis, serial, None, None\n" + \
        "I6, x, atypical melanocytic proliferation, serial, 7, None\nI5, x, nevus, serial, None, None\n"
    meta = "image_id,age,sex\nC1,unknown,male\nC2,35,unknown\nC3,40,female\nC4,41,female\n"
    truth = "image_id,melanoma,seborrheic_keratosis\nC1,1.0,0.0\nCX,0.0,1.0\nC3,0.0,1.0\n"
    irma = "image,melanoma\nR1,1\nR2,0\n"
    ph2 = "image,hist,common,atypical,melanoma\nP1,X,X,,\nP2,,,X,\nP3,,,,X\n"
    dermofit = "image,dx\nD1,MEL\nD1,SK\nD2,SK\nD3,AK\n"
    near = "I1, dupA\nC1, dupB\nR1, dupC\nI1, dupZ\n"
    f = {n: write(d / f"{n}.csv", t) for n, t in dict(atlas=atlas, archive=archive, meta=meta, truth=truth, irma=irma, ph2=ph2,
                                                    dermofit=dermofit, near=near).items()}
    files = "A1 A2 I1 I2 I3 I4 I5 I6 C1 C3 R1 R2 P1 P2 P3 D1 D2 D3".split()
    return f, spark.createDataFrame([(i,) for i in files], "image string")


def raw(spark, f):
    zipped, off = G.zip_challenge(T.scan_delimited(spark, f["meta"], schemas.CHALLENGE_META, line_no="line_no"),
                                  T.scan_delimited(spark, f["truth"], schemas.TRUTH_TEXT, line_no="line_no"))
    table = {"atlas": T.scan_tsv(spark, f["atlas"], schemas.ATLAS, "line_no"), "challenge": zipped}
    for name, s in (("archive", schemas.ARCHIVE), ("irma", schemas.IRMA), ("ph2", schemas.PH2), ("dermofit", schemas.DERMOFIT)):
        table[name] = T.scan_delimited(spark, f[name], s, line_no="line_no")
    return table, off


EXPECTED = {
    "ALL": "A1 A2 A1 I1 I2 I3 I4 I5 I6 I5 C1 C3 R1 R2 P1 P2 P3 D1 D2 D3",
    "CHALLENGE": "A1 A2 A1 I1 I5 C1 C3 R1 P1 P3 D1 D2 D3",
    "DEPLOY": "A1 A2 A1 I1 I5 C1 C3 R1 P1 P3 D1 D2 D3",
}


@pytest.mark.parametrize("mode", N.MODES)
def test_six_sources_become_one_table(spark, sources, mode):
    f, listing = sources
    table, off = raw(spark, f)
    near = T.scan_key_values(spark, f["near"]) if mode == "DEPLOY" else None
    rows, rejects = G.integrate(table, listing, mode, near, off)
    kept = rows.orderBy("source_no", "line_no").collect()
    assert " ".join(r["image"] for r in kept) == EXPECTED[mode]
    by = {(r["image"], r["dataset"]): r for r in kept}
    cases = {r["image"]: r["case_id"] for r in kept if r["dataset"] != "atlas"}
    assert {k: v for k, v in cases.items() if v} == ({"I1": "dupZ", "C1": "dupB", "R1": "dupC"} if mode == "DEPLOY" else {})
    assert by["A2", "atlas"]["case_id"] == "B1" and by["A2", "atlas"]["weight"] == 1.5
    assert (by["A2", "atlas"]["age"], by["A2", "atlas"]["has_age"], by["A2", "atlas"]["type"]) == ("", 0, "d")
    assert (by["I1", "isic"]["weight"], by["I5", "isic"]["weight"], by["I1", "isic"]["melanoma"]) == (3.0, 1.0, 1)
    assert (by["C1", "challenge"]["age"], by["C1", "challenge"]["melanoma"], by["C3", "challenge"]["keratosis"]) == ("", 1, 1)
    assert (by["P1", "ph2"]["weight"], by["P3", "ph2"]["melanoma"], by["P3", "ph2"]["weight"]) == (3.0, 1, 1.0)
    assert (by["D1", "dermofit"]["melanoma"], by["D2", "dermofit"]["keratosis"]) == (1, 1)
    why = sorted((r["reason"], r["image"]) for r in rejects.collect())
    # the missing picture between two equal neighbours does not separate them
    # the filters make the two rows of I5 neighbours
    assert why == sorted([("duplicate", "A1"), ("duplicate", "A1"), ("duplicate", "D1"), ("mismatched", "C2"), ("missing", "NOFILE")]
                         + ([("duplicate", "I5")] if mode != "ALL" else []))


def test_modes_are_checked(spark, sources):
    table, _ = raw(spark, sources[0])
    for call in (lambda: G.integrate(table, sources[1], "SOME"), lambda: G.integrate(table, sources[1], "DEPLOY"),
                 lambda: G.integrate({"other": table["irma"]}, sources[1], "ALL")):
        with pytest.raises(ValueError):
            call()


def test_line_numbers_span_file_blocks(spark, tmp_path):
    path = write(tmp_path / "big.csv", "id,age,sex\n" + "".join(f"IMG{i:05d},{i},x\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        df = T.scan_delimited(spark, path, schemas.CHALLENGE_META, line_no="n")
        assert df.rdd.getNumPartitions() > 1
        assert all(int(r["age"]) == r["n"] for r in df.collect()) and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_restart_in_every_file(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "many" / f"{k}.csv", "id,age,sex\n" + "".join(f"{k}-{i},{i},x\n" for i in range(10 + k)))
    df = T.scan_delimited(spark, str(tmp_path / "many"), schemas.CHALLENGE_META, line_no="n")
    assert df.count() == 33 and df.filter("cast(age as int) <> n").count() == 0


def test_truth_keys_and_maps(spark, tmp_path):
    truth = T.scan_truth(spark, write(tmp_path / "t.csv", "image_id,mel,ker\na,0.0,1.0\nb ,1.0, 0.0\n"))
    assert sorted(map(tuple, truth.collect())) == [("a", 0, 1), ("b", 1, 0)]
    keys = T.scan_keys(spark, write(tmp_path / "k.txt", " a \n\nb\n"))
    assert [r[0] for r in keys.collect()] == ["a", "", "b"]
    near = T.scan_key_values(spark, write(tmp_path / "n.csv", "a, x\nb, y\na, z\n"))
    assert sorted(map(tuple, near.collect())) == [("a", "z"), ("b", "y")]


def test_clinical_documents_with_absent_levels(spark, tmp_path):
    for name, text in {"I1.json": '{"meta": {"clinical": {"diagnosis": "nevus", "age_approx": 30, "sex": null}}}',
                       "I2.x.json": '{\n "meta": {}\n}', "I3.json": "{}"}.items():
        write(tmp_path / "meta" / name, text)
    rows = {r["image"]: r for r in T.scan_clinical(spark, str(tmp_path / "meta")).collect()}
    assert (rows["I1"]["diagnosis"], rows["I1"]["age_approx"], rows["I1"]["sex"]) == ("nevus", "30", None)
    assert rows["I2"]["diagnosis"] is None and rows["I3"]["sex"] is None
    df = T.scan_clinical(spark, str(tmp_path / "meta"))
    assert tuple(N.nonnull_counts(df, ["diagnosis", "sex"]).first()) == (3, 1, 0)
    sets = {tuple(r) for r in N.distinct_values(df, ["diagnosis", "sex"]).collect()}
    assert sets == {("diagnosis", "nevus"), ("diagnosis", "None"), ("sex", "None")}
    assert {r["sex"] for r in N.null_to_none(df, ["sex"]).collect()} == {"None"}


def test_component_files_with_a_short_line(spark, tmp_path):
    write(tmp_path / "c" / "partial_rc25_50_s_2.txt", "a,0.1,0.2\nb, 0.3\n")
    write(tmp_path / "c" / "partial_rc30_1.txt", "a,0.5,0.6\n")
    write(tmp_path / "c" / "other.txt", "z,1,1\n")
    got = sorted(map(tuple, T.scan_components(spark, str(tmp_path / "c")).collect()))
    assert got == [("rc25_50_s", 2, "a", 0.1, 0.2, False), ("rc25_50_s", 2, "b", 0.3, None, True), ("rc30", 1, "a", 0.5, 0.6, False)]


def test_test_metadata_keeps_and_flags_repeats(spark):
    df = spark.createDataFrame([(0, "a", "30", "male"), (1, "a", "unknown", "unknown"), (2, "b", "1", "x"), (3, "a", "2", "x")],
                               "line_no long, image string, age string, sex string")
    got = [(r["image"], r["duplicate"], r["age"], r["has_sex"]) for r in N.norm_test(df).orderBy("line_no").collect()]
    assert got == [("a", False, "30", 1), ("a", True, "", 0), ("b", False, "1", 1), ("a", False, "2", 1)]


def test_masks_are_left_out(spark):
    df = spark.createDataFrame([("x/a.jpg",), ("x/a_superpixels.png",), ("x/b_mask.png",)], "path string")
    assert [r[0] for r in T.drop_masks(df).collect()] == ["x/a.jpg"]


def test_clinical_folders_are_read_a_few_at_a_time(spark, tmp_path):
    folders = [str(tmp_path / f"f{k}") for k in range(5)]
    for k, folder in enumerate(folders):
        os.mkdir(folder)
        for i in range(7):
            with open(f"{folder}/D{k}_{i}.v1.json", "w") as f:
                f.write(('{"meta": {"clinical": {"diagnosis": "d%d", "age_approx": %d}}}' % (k, i), '{"meta": {}}', "no json", "[]", "", "[{}, {}]", "{}{}")[i])
    whole = T.scan_clinical(spark, f"{tmp_path}/f*").orderBy("image")
    apart = T.scan_clinical(spark, folders).orderBy("image")
    assert apart.dtypes == whole.dtypes and apart.collect() == whole.collect()
    reads = []
    made = S.materialise_each(spark, folders, lambda s, f: reads.append(s) or T.scan_clinical(s, f), "t", together=2)
    # in a session of its own, and what is left is a stored table
    assert len(reads) == 5 and not any(s is spark for s in reads) and made.count() == whole.count()
    assert not any(".json" in f for f in made.inputFiles())
    with pytest.raises(Exception, match="nowhere"):
        T.scan_clinical(spark, [*folders, f"{tmp_path}/nowhere"])


def test_json_query_reads_folder_by_folder(spark, tmp_path, monkeypatch):
    from stackpool.queries import files
    from stackpool.queries import metadata as Q
    monkeypatch.setattr(files.files_in_folders, "__defaults__", (16,))
    given, whole = [], T.scan_clinical
    monkeypatch.setattr(T, "scan_clinical", lambda s, path: given.append(path) or whole(s, path))
    spark.range(100).selectExpr("id as doc_id", "concat('l', id % 3) as lang", "concat('s', id % 4) as source", "id as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["image"]: r for r in Q.scan_json_meta(spark, str(tmp_path)).collect()}
    assert len(given[0]) == 7 and max(len(os.listdir(f.removeprefix("file://"))) for f in given[0]) <= 40
    assert set(got) == {f"D{i}" for i in range(100)}
    for i in range(100):
        r = got[f"D{i}"]
        assert r["benign_malignant"] == (f"l{i % 3}" if i % 7 else None) and r["diagnosis"] == (f"s{i % 4}" if i % 11 else None)
        assert r["age_approx"] == (str(i % 90) if i % 11 else None)
