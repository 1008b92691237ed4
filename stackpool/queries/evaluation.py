"""Metrics, rankings, inversions and model selection."""

from pyspark.sql import functions as F

from stackpool.operators import joins as J
from stackpool.operators import metrics as M
from stackpool.operators import svm as V
from stackpool.operators.order import global_index
from stackpool.plans import stack as K
from stackpool.queries.pools import pooled_scores, pooled_sql
from stackpool.queries.registry import d6, query, r6
from stackpool.queries.scalars import ARGMAX
from stackpool.queries.views import duck, view
from stackpool.session import scratch_path
from stackpool.streaming import selection as L


def metric_sql(source: str, series: str = "", score: str = "score", y: str = "y") -> str:
    """auc, ap and ap_trapezoid per series of (score, y) rows."""
    part = f"partition by {series}" if series else ""
    keys = f"{series}, " if series else ""
    group = f"group by {series}" if series else ""
    return f"""select {keys}case when max(np)*max(nn) > 0 then sum(p*(nb+n/2))/(max(np)*max(nn)) end as auc,
      case when max(np) > 0 then sum(p*tp/(tp+fp))/max(np) end as ap,
      case when max(np) > 0 then sum(p*(tp/(tp+fp) + case when tp-p+fp-n > 0 then (tp-p)/(tp-p+fp-n) else 1 end)/2)/max(np) end as apt from (
      select *, np - pb as tp, nn - nb as fp from (select *, coalesce(sum(p) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as pb,
        coalesce(sum(n) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as nb,
        sum(p) over ({part}) as np, sum(n) over ({part}) as nn from (
        select {keys}{score} as score, sum({y})::double as p, sum(1-{y})::double as n from {source} group by {keys}{score}))) {group}"""


TASKS = """t as (select 'melanoma' as task, p_m as score, melanoma as y from v_pred1 join v_truth using (vec_id)
    union all select 'keratosis', p_k, keratosis from v_pred1 join v_truth using (vec_id))"""


@query("eval_auc", duck(f"""with {TASKS}, a as ({metric_sql('t', 'task')})
    select {d6("max(case when task='melanoma' then auc end)", 'melanoma_auc')}, {d6("max(case when task='keratosis' then auc end)", 'keratosis_auc')},
    {d6('avg(auc)', 'average_auc')} from a""", "v_pred1", "v_truth"))
def eval_auc(spark, sf):
    out = K.evaluate_auc(view(spark, sf, "v_pred1"), view(spark, sf, "v_truth"), "vec_id")
    return out.select(*[r6(c) for c in out.columns])


@query("eval_auc_by_position", duck(f"""with a0 as (select row_number() over (order by vec_id) as ln, p_m, p_k from v_pred1),
    b0 as (select row_number() over (order by vec_id desc) as ln, melanoma, keratosis from v_truth),
    t as (select 'melanoma' as task, p_m as score, melanoma as y from a0 join b0 using (ln) union all
    select 'keratosis', p_k, keratosis from a0 join b0 using (ln)), a as ({metric_sql('t', 'task')})
    select {d6("max(case when task='melanoma' then auc end)", 'melanoma_auc')}, {d6("max(case when task='keratosis' then auc end)", 'keratosis_auc')},
    {d6('avg(auc)', 'average_auc')} from a""", "v_pred1", "v_truth"))
def eval_auc_by_position(spark, sf):
    # truth in the opposite order: rows are paired by line number only
    left = global_index(view(spark, sf, "v_pred1"), ["vec_id"], "line_no")
    right = global_index(view(spark, sf, "v_truth"), [F.desc("vec_id")], "line_no")
    out = K.evaluate_auc(left, right, "vec_id", by_position=True)
    return out.select(*[r6(c) for c in out.columns])


@query("join_truth_repeated", duck("""with tt as (select *, vec_id as line_no from v_truth union all select vec_id, 1 - melanoma, keratosis, 1000000 + vec_id from v_truth where vec_id % 3 = 0)
    select p.vec_id, arg_max(tt.melanoma, line_no) as melanoma, arg_max(tt.keratosis, line_no) as keratosis from v_pred1 p join tt on p.vec_id = tt.vec_id group by p.vec_id""",
                                    "v_pred1", "v_truth"))
def join_truth_repeated(spark, sf):
    # every third id has a second, differing line: the last one counts and no row is added
    truth = view(spark, sf, "v_truth").select("vec_id", "melanoma", "keratosis", F.col("vec_id").alias("line_no"))
    again = truth.filter("vec_id % 3 = 0").select("vec_id", (1 - F.col("melanoma")).alias("melanoma"), "keratosis", (F.col("line_no") + 1000000).alias("line_no"))
    return J.join_truth(view(spark, sf, "v_pred1"), truth.unionByName(again), "vec_id").select("vec_id", "melanoma", "keratosis")


@query("join_truth", duck(f"select p.vec_id, {d6('p_m', 'p_m')}, {d6('p_k', 'p_k')}, melanoma, keratosis from v_pred1 p join v_truth t on p.vec_id = t.vec_id", "v_pred1", "v_truth"))
def join_truth(spark, sf):
    out = J.join_truth(view(spark, sf, "v_pred1"), view(spark, sf, "v_truth"), "vec_id")
    return out.select("vec_id", r6("p_m"), r6("p_k"), "melanoma", "keratosis")


@query("auc", duck(f"select {d6('auc', 'auc')} from ({metric_sql('v_bigscore')})", "v_bigscore"))
def auc(spark, sf):
    return M.ranking_metrics(view(spark, sf, "v_bigscore"), "score", "y").select(r6("auc"))


@query("avg_precision", duck(f"select stratum, {d6('ap', 'ap')}, {d6('apt', 'ap_trapezoid')} from ({metric_sql('v_bigscore', 'stratum')})", "v_bigscore"))
def avg_precision(spark, sf):
    return M.ranking_metrics(view(spark, sf, "v_bigscore"), "score", "y", ["stratum"]).select("stratum", r6("ap"), r6("ap_trapezoid"))


@query("auc_ties", f"""select l_shipmode, {d6('auc', 'auc')}, {d6('ap', 'ap')} from ({metric_sql("(select l_linenumber as l_shipmode, l_discount as score, case when l_returnflag='R' then 1 else 0 end as y from lineitem)", 'l_shipmode')})""")
def auc_ties(spark, sf):
    # eleven distinct scores only
    rows = view(spark, sf, "lineitem").select(F.col("l_linenumber").alias("l_shipmode"), F.col("l_discount").alias("score"),
                                              (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return M.ranking_metrics(rows, "score", "y", ["l_shipmode"]).select("l_shipmode", r6("auc"), r6("ap"))


OVR = "o as (" + " union all ".join(
    f"select {j} as class, round(p{j}, 12) as score, case when truth={j} then 1 else 0 end as y from pooled" for j in range(3)) + ")"


def _ovr(spark, sf):
    rows = M.one_vs_rest(pooled_scores(spark, sf), "probabilities", "truth", 3)
    # sums of doubles differ in the last bit between engines; scores are compared at twelve places
    return M.ranking_metrics(rows.withColumn("score", F.round("score", 12)), "score", "y", ["class"])


@query("auc_ovr", duck(f"with pooled as ({pooled_sql('avg')}), {OVR} select class, {d6('auc', 'auc')}, {d6('ap', 'ap')} from ({metric_sql('o', 'class')})", "v_logits"))
def auc_ovr(spark, sf):
    return _ovr(spark, sf).select("class", r6("auc"), r6("ap"))


@query("auc_avg", duck(f"""with pooled as ({pooled_sql('avg')}), {OVR}, a as ({metric_sql('o', 'class')}) select {d6('avg(auc)', 'auc_avg')}, {d6('avg(ap)', 'map_avg')},
    {d6('avg(case when class > 0 then auc end)', 'isbi')} from a""", "v_logits"))
def auc_avg(spark, sf):
    return _ovr(spark, sf).agg(r6(F.avg("auc"), "auc_avg"), r6(F.avg("ap"), "map_avg"), r6(F.avg(F.when(F.col("class") > 0, F.col("auc"))), "isbi"))


_PRED = f"pooled as ({pooled_sql('avg')}), pr as (select *, {ARGMAX.format('p0', 'p1', 'p2')} as prediction from pooled)"


@query("accuracy", duck(f"with {_PRED} select {d6('avg(case when truth=prediction then 1.0 else 0.0 end)', 'acc')} from pr", "v_logits"))
def accuracy(spark, sf):
    return M.accuracy(pooled_scores(spark, sf), "truth", "prediction").select(r6("acc"))


@query("accuracy_truncated", duck(f"""select {d6('avg(case when l = trunc(p_m*3) then 1.0 else 0.0 end)', 'acc_1')}, {d6('avg(case when l = trunc(p_k*3) then 1.0 else 0.0 end)', 'acc_2')}
    from (select p.*, melanoma + 2*keratosis as l from v_pred1 p join v_truth using (vec_id))""", "v_pred1", "v_truth"))
def accuracy_truncated(spark, sf):
    # scores are tripled so that their whole part varies
    rows = J.join_truth(view(spark, sf, "v_pred1"), view(spark, sf, "v_truth"), "vec_id").select(
        (F.col("melanoma") + 2 * F.col("keratosis")).alias("label"), (F.col("p_m") * 3).alias("m"), (F.col("p_k") * 3).alias("k"))
    out = M.accuracy_truncated(rows, "label", {1: "m", 2: "k"})
    return out.select(r6("acc_1"), r6("acc_2"))


@query("confusion_matrix", duck(f"""with {_PRED}, ls as (select truth as l from pr union select prediction from pr)
    select a.l as truth, b.l as prediction, (select count(*) from pr where truth=a.l and prediction=b.l) as n from ls a, ls b""", "v_logits"))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(pooled_scores(spark, sf), "truth", "prediction")


@query("confusion_zeros", """with ls as (select l_linenumber as l from lineitem union select cast(trunc(l_tax*100)+1 as int) from lineitem)
    select a.l as truth, b.l as prediction, (select count(*) from lineitem where l_linenumber=a.l and cast(trunc(l_tax*100)+1 as int)=b.l) as n from ls a, ls b""")
def confusion_zeros(spark, sf):
    # the two label sets differ, so some pairs never occur
    rows = view(spark, sf, "lineitem").select(F.col("l_linenumber").alias("t"), ((F.col("l_tax") * 100).cast("int") + 1).alias("p"))
    return M.confusion_matrix(rows, "t", "p")


@query("metrics_row", duck(f"""with {_PRED}, {OVR}, a as ({metric_sql('o', 'class')}), w as (select max(case when class=1 then auc end) as a1, max(case when class=2 then auc end) as a2,
    max(case when class=1 then ap end) as m1, max(case when class=2 then ap end) as m2 from a), c as (select avg(case when truth=prediction then 1.0 else 0.0 end) as acc from pr)
    select 'model.ckpt-1' as checkpoint, {d6('acc', 'acc')}, {d6('a1', 'auc1')}, {d6('a2', 'auc2')}, {d6('m1', 'map1')}, {d6('m2', 'map2')}, {d6('(a1+a2)/2', 'isbi')} from w, c""", "v_logits"))
def metrics_row(spark, sf):
    pooled = pooled_scores(spark, sf).withColumn("probabilities", F.transform("probabilities", lambda p: F.round(p, 12)))
    out = M.metrics_row(pooled, "truth", "model.ckpt-1")
    return out.select("checkpoint", *[r6(c) for c in out.columns[1:]])


# --- rankings ------------------------------------------------------------------------

@query("rank_scores", duck("select vec_id, row_number() over (order by p_m, vec_id) - 1 as rank from v_pred1", "v_pred1"))
def rank_scores(spark, sf):
    return M.rank_scores(view(spark, sf, "v_pred1"), "p_m", "vec_id").select("vec_id", "rank")


@query("rank_scores_big", duck("select k1, k2, stratum, y, score, row_number() over (order by score, k1, k2, stratum, y) - 1 as rank from v_bigscore", "v_bigscore"))
def rank_scores_big(spark, sf):
    return global_index(view(spark, sf, "v_bigscore"), ["score", "k1", "k2", "stratum", "y"], "rank")


def _inv_sql(p: str, label: str) -> str:
    return f"""select '{label}' as task, count(*) as inversions, count(*) filter (where a.t <> b.t) as significant from
      (select row_number() over (order by a.{p}, a.vec_id) as r1, row_number() over (order by b.{p}, b.vec_id) as r2, {label} as t
       from v_pred1 a join v_pred2 b using (vec_id) join v_truth using (vec_id)) a join
      (select row_number() over (order by a.{p}, a.vec_id) as r1, row_number() over (order by b.{p}, b.vec_id) as r2, {label} as t
       from v_pred1 a join v_pred2 b using (vec_id) join v_truth using (vec_id)) b on a.r2 < b.r2 and a.r1 > b.r1"""


@query("inversions", duck(_inv_sql("p_m", "melanoma") + " union all " + _inv_sql("p_k", "keratosis"), "v_pred1", "v_pred2", "v_truth"))
def inversions(spark, sf):
    def lines(name):
        return view(spark, sf, name).withColumn("line_no", F.col("vec_id"))
    out = K.compare_runs(lines("v_pred1"), lines("v_pred2"), view(spark, sf, "v_truth"), "vec_id")
    return out.select("task", F.col("inversions").cast("long").alias("inversions"), F.col("significant").cast("long").alias("significant"))


def _bits_sql(levels: int = 24) -> str:
    """Inversions without pairs: a pair is found at the highest bit in which its first ranks differ."""
    def count(part: str, name: str) -> str:
        return (f"select sum(ones) as {name} from (select case when bit = 0 then sum(bit) over (partition by lvl, r1 >> (lvl + 1){part} order by r2) end as ones "
                f"from (select r1, r2, t, lvl, (r1 >> lvl) & 1 as bit from q, (select unnest(generate_series(0, {levels - 1})) as lvl)))")
    return f"""with l as (select *, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as line_no from lineitem),
    q as (select row_number() over (order by l_extendedprice, line_no) - 1 as r1, row_number() over (order by l_quantity, line_no) - 1 as r2,
        case when l_returnflag = 'R' then 1 else 0 end as t from l),
    a as ({count('', 'n')}), s as ({count(', t', 'n')})
    select cast(a.n as bigint) as inversions, cast(a.n - s.n as bigint) as significant from a, s"""


@query("inversions_big", _bits_sql())
def inversions_big(spark, sf):
    """Price order against quantity order of all order lines."""
    rows = global_index(view(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "line_no")
    rows = rows.select("line_no", "l_extendedprice", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("t"))
    ranked = M.rank_scores(M.rank_scores(rows, "l_extendedprice", "line_no", "rank1"), "l_quantity", "line_no", "rank2")
    out = M.count_inversions(ranked, "rank1", "rank2", "t")
    return out.select(F.col("inversions").cast("long").alias("inversions"), F.col("significant").cast("long").alias("significant"))


@query("cv_mean", f"""with f as (select l_linenumber as trial, cast(l_suppkey % 3 as int) as fold, l_extendedprice as score, case when l_returnflag='R' then 1 else 0 end as y from lineitem),
    a as ({metric_sql('f', 'trial, fold')}), n as (select trial, fold, count(*) as n from f group by trial, fold)
    select trial, {d6('sum(n*auc)/sum(n)', 'mean_auc')} from a join n using (trial, fold) group by trial""")
def cv_mean(spark, sf):
    rows = view(spark, sf, "lineitem").select(F.col("l_linenumber").alias("trial"), (F.col("l_suppkey") % 3).cast("int").alias("fold"),
                                              F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    per_fold = M.ranking_metrics(rows, "score", "y", ["trial", "fold"])
    sizes = rows.groupBy("trial", "fold").agg(F.count(F.lit(1)).alias("n"))
    return V.cv_mean(per_fold.join(sizes, ["trial", "fold"]), ["trial"]).select("trial", r6("mean_auc"))


# --- model selection --------------------------------------------------------------------

@query("best_score", duck("select model, max(score) as best from v_ckpt group by model", "v_ckpt"))
def best_score(spark, sf):
    return L.best_score(view(spark, sf, "v_ckpt"))


_IMP = """select model, seq, score, best_before, coalesce(score, best_before) > best_before * 1.001::double as improved from (
    select *, coalesce(max(score) over (partition by model order by seq rows between unbounded preceding and 1 preceding), 0) as best_before from v_ckpt)"""


@query("improvements", duck(_IMP, "v_ckpt"))
def improvements(spark, sf):
    return L.improvements(view(spark, sf, "v_ckpt")).select("model", "seq", "score", "best_before", "improved")


@query("latest_checkpoint", "select user_id, arg_max(event_id, {'t': ts, 'e': event_id}) as event_id from events group by user_id")
def latest_checkpoint(spark, sf):
    return L.latest(view(spark, sf, "events"), ["user_id"], "event_id", "ts")


def _log_files(spark, sf):
    """The score log as Parquet files; entries of a model arrive in order."""
    path = scratch_path(spark, "score-log")
    log = view(spark, sf, "v_ckpt").select("model", F.concat(F.lit("model.ckpt-"), "checkpoint").alias("checkpoint"),
                                           F.col("seq").cast("long").alias("seq"), "score")
    log.repartition("model").sortWithinPartitions("model", "seq").write.parquet(path)
    return path


@query("stream_improvements", duck(_IMP, "v_ckpt"))
def stream_improvements(spark, sf):
    source, out = _log_files(spark, sf), scratch_path(spark, "selection")
    job = L.run_selection(spark, source, f"{out}/log", f"{out}/state", f"{out}/best", max_files=4)
    job.awaitTermination()
    return spark.read.parquet(f"{out}/log").select("model", "seq", "score", "best_before", "improved")


@query("stream_checkpoints", "select concat('model.ckpt-', cast(doc_id as string), '.index') as name, length(lang) as length from documents")
def stream_checkpoints(spark, sf):
    from stackpool.queries import files
    # one index file and one data file per checkpoint; only index files count
    docs = view(spark, sf, "documents")
    index = docs.select(F.concat(F.lit("model.ckpt-"), "doc_id", F.lit(".index")).alias("name"), F.col("lang").cast("binary").alias("content"))
    data = docs.select(F.concat(F.lit("model.ckpt-"), "doc_id", F.lit(".data")).alias("name"), F.col("source").cast("binary").alias("content"))
    out = scratch_path(spark, "checkpoints-seen")
    L.run_checkpoints(spark, files.files_in_folders(index.unionByName(data), "checkpoints"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").select("name", "length")


_MODEL = "concat('m', cast(vec_id % 3 as string))"


@query("stream_metrics", duck(f"""with pooled as ({pooled_sql('avg')}), pr as (select {_MODEL} as model, *, {ARGMAX.format('p0', 'p1', 'p2')} as prediction from pooled),
    o as ({" union all ".join(f"select model, {j} as class, round(p{j}, 12) as score, case when truth={j} then 1 else 0 end as y from pr" for j in (1, 2))}),
    a as ({metric_sql('o', 'model, class')}), c as (select model, count(*) as n, avg(case when truth=prediction then 1.0 else 0.0 end) as acc from pr group by model),
    w as (select model, max(case when class=1 then auc end) as a1, max(case when class=2 then auc end) as a2, max(case when class=1 then ap end) as m1, max(case when class=2 then ap end) as m2 from a group by model)
    select model, n, {d6('acc', 'acc')}, {d6('a1', 'auc1')}, {d6('a2', 'auc2')}, {d6('m1', 'map1')}, {d6('m2', 'map2')}, {d6('(a1+a2)/2', 'isbi')} from c join w using (model)""", "v_logits"))
def stream_metrics(spark, sf):
    """Predictions arrive in four micro-batches; the metrics after the last one."""
    out = scratch_path(spark, "evaluation")
    rows = pooled_scores(spark, sf).select(F.expr(_MODEL).alias("model"), F.col("truth").cast("int").alias("truth"), F.col("prediction").cast("int").alias("prediction"),
                                           F.transform("probabilities", lambda p: F.round(p, 12)).alias("probabilities"), F.pmod(F.xxhash64("vec_id"), F.lit(4)).alias("part"))
    rows.repartition(4, "part").drop("part").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    L.run_evaluation(spark, stream, f"{out}/found", f"{out}/state").awaitTermination()
    found = spark.read.parquet(f"{out}/found/metrics")
    last = found.groupBy("model").agg(F.max("batch").alias("batch"))
    found = found.join(last, ["model", "batch"])
    return found.select("model", "n", *[r6(c) for c in ("acc", "auc1", "auc2", "map1", "map2", "isbi")])
