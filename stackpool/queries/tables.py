"""Stored splits, records, features and text outputs: written, then read back."""

from pyspark.sql import functions as F

from stackpool.operators import ensemble as E
from stackpool.plans import dataset as D
from stackpool.queries import files
from stackpool.queries.registry import d6, query, r6
from stackpool.queries.splits import _SHARD, SPLIT
from stackpool.queries.views import duck, pictures, view
from stackpool.session import scratch_path
from stackpool.sources import tables as T
from stackpool.sources import text as X
from stackpool.sources.images import list_files as list_pictures


def _stored(spark, sf):
    folder = scratch_path(spark, "dataset")
    T.write_shards(D.training_rows(view(spark, sf, "v_meta"), per_shard=64), folder)
    return folder


@query("write_shards", duck(f"with {SPLIT}" + _SHARD.format(order="md5(concat('1:', image))", src="final", per=64, third=21)
                            .replace("select image, line_no, split", "select split, min(pos) as first_pos, max(pos) as last_pos, count(*) as n, cast(least(pos // 64, ns-1) as int) as shard from h group by split, shard --")
                            .split("--")[0], "v_meta"))
def write_shards(spark, sf):
    rows = spark.read.parquet(_stored(spark, sf))
    return rows.groupBy("split", "shard").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


@query("read_split", duck(f"with {SPLIT} select image, stratum, line_no from final where split = 'validation'", "v_meta"))
def read_split(spark, sf):
    return T.get_dataset(spark, "skin_lesions", "validation", _stored(spark, sf)).select("image", "stratum", "line_no")


@query("split_log", duck(f"with {SPLIT} select split, image from final", "v_meta"))
def split_log(spark, sf):
    folder = scratch_path(spark, "split-log")
    T.write_split_logs(D.training_rows(view(spark, sf, "v_meta")), folder)
    return spark.read.text(folder).select("split", F.col("value").alias("image"))


def _records(spark, sf):
    pics = pictures(spark, sf).withColumn("format", F.lit("png")).withColumnRenamed("data", "encoded")
    meta = view(spark, sf, "v_picture_size").select(
        "image", F.lit("").alias("case_id"), F.when(F.col("height") == 5, "c").otherwise("d").alias("type"),
        F.when(F.col("width") == 9, "").otherwise((F.col("vec_id") % 90).cast("string")).alias("age"), (F.col("width") - 9).alias("has_age"),
        F.lit("female").alias("sex"), F.lit(1).alias("has_sex"), (F.col("truth") == 1).cast("int").alias("melanoma"),
        (F.col("truth") == 2).cast("int").alias("keratosis"), F.lit(2).alias("schedule"), F.lit(5).alias("weight"), F.col("vec_id").alias("line_no"))
    return D.records(D.test_rows(meta), pics)


@query("records", duck("""select image, cast(truth as bigint) as label, case when height=5 then 0.0 else 1.0 end::float as type,
    case when width=9 then 0.0 else vec_id % 90 end::float as age, height, width, height*width*3 as bytes, 'png' as format from v_picture_size""", "v_picture_size"))
def records(spark, sf):
    return _records(spark, sf).select("image", "label", "type", "age", "height", "width", F.length("encoded").alias("bytes"), "format")


@query("records_from_files", duck("""select image, cast(truth as bigint) as label, height::bigint as height, width::bigint as width, 'png' as format,
    cast(least(pos // 64, case when n % 64 < 21 then greatest(ceil(n/64.0)-1, 1) else ceil(n/64.0) end - 1) as int) as shard
    from (select *, row_number() over (order by vec_id) - 1 as pos, count(*) over () as n from v_picture_size)""", "v_picture_size"))
def records_from_files(spark, sf):
    folder, pics = scratch_path(spark, "sharded"), pictures(spark, sf)
    listing = list_pictures(spark, files.png_files(pics))
    meta = view(spark, sf, "v_picture_size").select(
        "image", F.lit("").alias("case_id"), F.lit("d").alias("type"), F.lit("").alias("age"), F.lit(0).alias("has_age"), F.lit("").alias("sex"),
        F.lit(0).alias("has_sex"), (F.col("truth") == 1).cast("int").alias("melanoma"), (F.col("truth") == 2).cast("int").alias("keratosis"),
        F.lit(0).alias("schedule"), F.lit(0).alias("weight"), F.col("vec_id").alias("line_no"))
    T.write_shards(D.records_from_files(D.test_rows(meta, per_shard=64), listing), folder, placed=True)
    return spark.read.parquet(folder).select("image", "label", "height", "width", "format", "shard")


@query("read_items", duck("select image, 'jpg' as format, cast(truth as bigint) as label, 5.0::float as weight, 0 as mask from v_picture_size", "v_picture_size"))
def read_items(spark, sf):
    folder = scratch_path(spark, "records")
    # stored without format and mask: both come back as defaults, and the bytes are not read
    _records(spark, sf).drop("format").write.partitionBy("split").parquet(folder)
    stored = T.read_split(spark, folder, "test")
    return T.read_items(stored, ["image", "format", "label", "weight", "mask"], {**T.schemas.RECORD_DEFAULTS, "mask": 0})


def _features(spark, sf):
    return view(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "label",
                                                F.col("embedding").cast("array<double>").alias("features"))


_FEATS = f"select cast(vec_id as varchar) as id, label, cast(pos as int) as pos, {d6('x', 'x')} from (select vec_id, label, unnest(embedding)::double as x, unnest(generate_series(0,63)) as pos from embeddings)"


@query("scan_features", _FEATS)
def scan_features(spark, sf):
    folder = scratch_path(spark, "features")
    T.write_features(_features(spark, sf), folder, 64)
    return T.scan_features(spark, folder).select("id", "label", F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


@query("write_features", "select count(*) as num_samples, 64 as feature_size, '{}' as options from embeddings")
def write_features(spark, sf):
    folder = scratch_path(spark, "features")
    T.write_features(_features(spark, sf), folder, 64)
    return spark.read.parquet(f"{folder}/header")


@query("feature_text", "select cast(vec_id as varchar) as id, cast(label as varchar) as truth, "
       + ", ".join(f"printf('%.16f', embedding[{i + 1}]::double) as \"feature[{i}]\"" for i in range(64)) + " from embeddings")
def feature_text(spark, sf):
    return T.feature_text(_features(spark, sf), 64)


_SETS = "case feature_set " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(E.FEATURE_ORDER)) + " end"


@query("scan_components", duck(f"""select {_SETS} as set_name, replica, cast(vec_id as varchar) as image, {d6('p_m', 'p_m')},
    {d6("case when vec_id % 100 = 7 then null else p_k end", 'p_k')}, vec_id % 100 = 7 as bad_width from v_components""", "v_components"))
def scan_components(spark, sf):
    # one folder per component file; some lines lack a field
    comps = view(spark, sf, "v_components")
    name = F.concat(F.lit("partial_"), F.expr(_SETS), F.lit("_"), "replica", F.lit(".txt"))
    line = F.concat_ws(",", F.col("vec_id").cast("string"), F.concat(F.lit(" "), "p_m"), F.when(F.col("vec_id") % 100 != 7, F.col("p_k").cast("string")))
    folder = scratch_path(spark, "components")
    comps.select(name.alias("file"), line.alias("value")).write.partitionBy("file").text(folder)
    out = X.scan_components(spark, folder, glob="part-*")
    return out.select("set_name", "replica", "image", r6("p_m"), r6("p_k"), "bad_width")


@query("write_scores", """select cast(l_orderkey as varchar) as image, cast(l_linenumber as varchar) as truth, printf('%.16f', l_discount) as "other[0]",
    printf('%.16f', l_tax) as "melanoma[1]", printf('%.16f', l_quantity/64) as "keratosis[2]", cast(l_suppkey % 3 as varchar) as prediction from lineitem""")
def write_scores(spark, sf):
    pooled = view(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("image"), F.col("l_linenumber").alias("truth"),
                                                F.array("l_discount", "l_tax", F.col("l_quantity") / 64).alias("probabilities"),
                                                (F.col("l_suppkey") % 3).alias("prediction"))
    folder = scratch_path(spark, "scores")
    T.write_scores(pooled, folder)
    return spark.read.option("header", True).schema("image string, truth string, `other[0]` string, `melanoma[1]` string, `keratosis[2]` string, prediction string").csv(folder)


@query("write_row_count", "select count(*) as num_samples from lineitem")
def write_row_count(spark, sf):
    pooled = view(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("image"), F.col("l_linenumber").alias("truth"),
                                                F.array("l_discount", "l_tax", F.col("l_quantity") / 64).alias("probabilities"),
                                                (F.col("l_suppkey") % 3).alias("prediction"))
    folder = scratch_path(spark, "scores")
    T.write_scores(pooled, f"{folder}/rows")
    T.write_row_count(spark, f"{folder}/rows", f"{folder}/header")
    return spark.read.schema("num_samples long").json(f"{folder}/header")


@query("write_metadata_summary", """select 'event_type' as "column", count(event_type) as "values", count(distinct event_type) as distinct_values from events union all
    select 'user_id', count(user_id), count(distinct user_id) from events""")
def write_metadata_summary(spark, sf):
    folder = scratch_path(spark, "summary")
    T.write_metadata_summary(view(spark, sf, "events"), ["event_type", "user_id"], folder)
    return spark.read.schema("column string, values long, distinct_values long").json(folder)


@query("write_submission", duck(f"select cast(vec_id as varchar) as image, {d6('p_m', 'p_m')}, {d6('p_k', 'p_k')} from v_pred2", "v_pred2"))
def write_submission(spark, sf):
    folder = scratch_path(spark, "submission")
    T.write_submission(view(spark, sf, "v_pred2").withColumnRenamed("vec_id", "image"), folder)
    return X.scan_predictions(spark, folder).select("image", r6("p_m"), r6("p_k"))


@query("write_sizes", duck(f"with {SPLIT} select split, count(*) as n from final group by split", "v_meta"))
def write_sizes(spark, sf):
    from stackpool.operators.split import split_counts
    folder = scratch_path(spark, "sizes")
    T.write_sizes(split_counts(D.training_rows(view(spark, sf, "v_meta"))), folder)
    return spark.read.schema("split string, n long").json(folder)


@query("write_metadata_text", "select cast(event_id as varchar) as event_id, event_type as diagnosis, case when user_id%3=0 then 'None' else cast(user_id%90 as varchar) end as age_approx from events")
def write_metadata_text(spark, sf):
    from stackpool.queries.metadata import _clinical
    folder = scratch_path(spark, "metadata-text")
    T.write_metadata_text(_clinical(spark, sf).select("event_id", "diagnosis", "age_approx"), folder, ["diagnosis", "age_approx"])
    return spark.read.schema("event_id string, diagnosis string, age_approx string").option("header", True).csv(folder)


@query("run_log", "select cast(count(*) as varchar) as n, cast(date_diff('microsecond', min(ts), max(ts)) as double)/1000000 as elapsed_seconds from events")
def run_log(spark, sf):
    # the run described is the span of the event table
    span = view(spark, sf, "events").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count(F.lit(1)).alias("n")).first()
    log = T.run_log(spark, {"n": span["n"]}, span["a"], span["b"])
    return log.select(F.col("options")["n"].alias("n"), "elapsed_seconds")


@query("list_files", "select concat('D', cast(doc_id as varchar), '.v1') as image from documents")
def list_files(spark, sf):
    docs = view(spark, sf, "documents").select(F.concat(F.lit("D"), "doc_id", F.lit(".v1.jpg")).alias("name"), F.col("lang").cast("binary").alias("content"))
    return list_pictures(spark, files.files_in_folders(docs, "listing"), "*.jpg").select("image")
