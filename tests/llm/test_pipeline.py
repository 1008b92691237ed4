"""The stages on a small folder of tables, each against what its operator says."""

import os

import pytest

import corpus_pipeline
from stackpool.llm import packing, secrets
from tests.llm.test_llm import WORD_BPE, best_fit, copies, frame, least_reached, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    secret = 'here token = "f6f4b6c25fd9db1a3d0f51bedd389b0833f73c65" stands '
    texts = copies(3) + [secret + t for t in prose(4, 9)] + [" | ".join(t.split()) + " ###" for t in prose(60, 6, 80)]
    good = len(texts) - 60
    frame(spark, texts).drop("node", "sig").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < good), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_follow_each_other(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(os.path.join(folder, f"out-{name}"))
        seen[name], docs = docs, spark.read.parquet(os.path.join(folder, f"out-{name}"))
        if name != "best_fit_packing":
            assert docs.columns == names
    first, second, third, last = (n for n, _ in corpus_pipeline.STAGES)
    # what the classifier kept, one of each group stays
    before = {r["doc_id"]: r["text"] for r in seen[second].collect()}
    ids = sorted(before)
    _, label = least_reached([before[i] for i in ids], corpus_pipeline.WIDTH)
    assert sorted(r["doc_id"] for r in seen[third].collect()) == [i for k, i in enumerate(ids) if label[k] == k]
    # no document is lost and no secret stays
    clean = {r["doc_id"]: r["text"] for r in seen[last].collect()}
    assert set(clean) == {r["doc_id"] for r in seen[third].collect()} and not any(secrets.scan(t)[1] for t in clean.values())
    rows = docs.collect()
    assert {r["doc_id"] for r in rows} == set(clean)
    assert len({r["sequence_id"] for r in rows}) == len(best_fit([r["length"] for r in rows], corpus_pipeline.CAPACITY))
    assert packing.pack(seen[last], WORD_BPE).count() == len(rows)


def test_run_gives_the_last_stage(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_stages_take_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
