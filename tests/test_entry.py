"""Registered queries against their SQL on the smallest tables, and the shape of their plans."""

import os
import re
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

import __spark_entry__ as entry
from tests.conftest import DATA
from tools.check_oracle import plain

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# One of each kind by default; STACKPOOL_ALL=1 runs every pair, as tools/check_oracle.py does.
SOME = """anti_blacklist append_scores argmax_class assemble_meta aggregate_replicas auc auc_ovr avg_precision bits_from_prob
    check_contamination check_id_lists deploy_split join_truth_repeated inversions_big svm_fit component_features component_scores confusion_zeros cross_entropy cv_mean dedup_adjacent
    distinct_sets encode_record eval_auc eval_auc_by_position feature_histogram final_submission format_scores group_folds_balanced
    img_color img_crop_boxes img_replicas img_resize_methods img_vgg_train improvements integrate_sources inversions json_extract
    metrics_row norm_archive norm_test pool_by_id_runs pool_by_id_xtrm pool_features_xtrm pool_scores_avg preprocess_pca
    rank_scores_big read_items records_from_files rejects scan_components scan_images scan_metadata scan_neardup shards split
    stratified_folds stream_improvements trial_grid write_shards zip_mismatch zscore_stats""".split()
CHOSEN = sorted(ORACLES) if os.environ.get("STACKPOOL_ALL") else SOME
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("key", CHOSEN)
def test_query_equals_its_sql(spark, duck, key):
    df = QUERIES[key](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    res = duck.execute(ORACLES[key])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == names
    at = [cols.index(n) for n in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=str)


# the numbered queries and the pipeline have tests of their own
@pytest.mark.parametrize("key", sorted(k for k in set(QUERIES) - set(ORACLES) if not re.match(r"op\d+_|pipeline$", k)))
def test_query_without_sql_gives_rows(spark, key):
    assert QUERIES[key](spark, DATA).count() > 0


def test_flagship(spark):
    assert entry.entry(spark).columns == ["melanoma_auc", "keratosis_auc", "average_auc"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", ["eval_auc", "metrics_row", "split", "integrate_sources", "assemble_meta", "inversions", "improvements",
                                 "pool_by_id_xtrm", "rank_scores_big", "final_submission"])
def test_no_products_or_row_python(spark, key):
    text = plan(QUERIES[key](spark, DATA))
    assert not any(w in text for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"))


def test_assembly_shuffles_once_and_hashes(spark):
    text = plan(QUERIES["assemble_meta_probs"](spark, DATA))
    assert text.count("Exchange") == 1 and "SortAggregate" not in text


def test_picture_sizes_do_not_read_pictures(spark):
    assert "embedding" not in plan(QUERIES["img_dims"](spark, DATA)).split("ReadSchema")[-1]


def test_items_do_not_read_bytes(spark):
    assert "encoded" not in plan(QUERIES["read_items"](spark, DATA)).split("ReadSchema")[-1]


def test_filters_reach_the_scan(spark, tmp_path):
    from stackpool.operators.normalise import filter_irma
    from stackpool.queries.views import view
    view(spark, DATA, "raw_irma").write.parquet(str(tmp_path / "irma"))
    assert "PushedFilters: [IsNotNull(melanoma), EqualTo(melanoma,1)]" in plan(filter_irma(spark.read.parquet(str(tmp_path / "irma"))))
