"""Replica pooling, pooling by id, ensemble assembly."""

from pyspark.sql import functions as F

from stackpool.operators import ensemble as E
from stackpool.operators import pooling as P
from stackpool.operators.order import global_index
from stackpool.plans import stack as K
from stackpool.queries.registry import d6, query, r6
from stackpool.queries.scalars import ARGMAX, BITS
from stackpool.queries.scalars import P as PROBS
from stackpool.queries.views import duck, view
from stackpool.session import scratch_path
from stackpool.sources import tables


def logits(spark, sf):
    return view(spark, sf, "v_logits").withColumn("logits", F.array("z0", "z1", "z2"))


def pooled_scores(spark, sf, mode="avg"):
    return P.pool_scores(logits(spark, sf), ["vec_id"], "logits", mode, 3, carry=["truth"])


def _flat(df, *more):
    return df.select("vec_id", *more, "truth", *[r6(F.col("probabilities")[i], f"p{i}") for i in range(3)],
                     *[r6(F.col("logits")[i], f"z{i}") for i in range(3)], "prediction")


def pooled_sql(mode: str) -> str:
    """SQL for the pooled scores: vec_id, truth, p0..p2, z0..z2 (unrounded)."""
    soft = ", ".join(f"{p} as p{i}" for i, p in enumerate(PROBS))
    if mode in ("avg", "max"):
        aggs = ", ".join([f"{mode}({p}) as p{i}" for i, p in enumerate(PROBS)] + [f"{mode}(z{i}) as z{i}" for i in range(3)])
        return f"select vec_id, min(truth) as truth, {aggs} from v_logits group by vec_id"
    agg = {"avg_logits": "avg(z{i})", "max_logits": "max(z{i})",
           "xtrm_logits": "arg_max(z{i}, {{'a': abs(z{i}), 'b': -replica}})"}[mode]
    inner = ", ".join(agg.format(i=i) + f" as z{i}" for i in range(3))
    return f"select vec_id, truth, {soft}, z0, z1, z2 from (select vec_id, min(truth) as truth, {inner} from v_logits group by vec_id)"


_COLS = ", ".join([d6(f"p{i}", f"p{i}") for i in range(3)] + [d6(f"z{i}", f"z{i}") for i in range(3)])


def _score_pool(mode):
    @query(f"pool_scores_{mode}", duck(
        f"select vec_id, truth, {_COLS}, {ARGMAX.format('p0', 'p1', 'p2')} as prediction from ({pooled_sql(mode)})", "v_logits"))
    def run(spark, sf):
        return _flat(pooled_scores(spark, sf, mode))


for _m in P.SCORE_MODES[:-1]:
    _score_pool(_m)


@query("pool_scores_none", duck(f"""select vec_id, replica, truth, {', '.join(d6(p, f'p{i}') for i, p in enumerate(PROBS))},
    {', '.join(d6(f'z{i}', f'z{i}') for i in range(3))}, {ARGMAX.format('z0', 'z1', 'z2')} as prediction from v_logits""", "v_logits"))
def pool_scores_none(spark, sf):
    return _flat(pooled_scores(spark, sf, "none"), "replica")


_FEATS = "select vec_id, replica, unnest([z0, z1, z2, z0*z1, z2-z0]) as x, unnest([0,1,2,3,4]) as pos from v_logits"


def _features(spark, sf):
    return logits(spark, sf).select("vec_id", "replica", F.array("z0", "z1", "z2", F.col("z0") * F.col("z1"),
                                                                 F.col("z2") - F.col("z0")).alias("features"))


def _feature_pool(mode, agg):
    keys = "vec_id, replica, pos" if mode == "none" else "vec_id, pos"
    @query(f"pool_features_{mode}", duck(f"select {keys}, {d6(agg, 'x')} from ({_FEATS}) group by {keys}", "v_logits"))
    def run(spark, sf):
        out = P.pool_features(_features(spark, sf), ["vec_id"], "features", mode)
        more = ["replica"] if mode == "none" else []
        return out.select("vec_id", *more, F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


for _m, _agg in (("avg", "avg(x)"), ("max", "max(x)"), ("xtrm", "arg_max(x, {'a': abs(x), 'b': -replica})"), ("none", "max(x)")):
    _feature_pool(_m, _agg)


@query("aggregate_replicas", f"""select cast(vec_id // 5 as bigint) as id, cast(vec_id // 5 as bigint) as grp, arg_min(label, vec_id) as label, pos,
    {d6('avg(x)', 'x')} from (select vec_id, label, unnest(embedding)::double as x, unnest(generate_series(0,63)) as pos from embeddings) group by vec_id // 5, pos""")
def aggregate_replicas(spark, sf):
    rows = view(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("id"), "vec_id", "label",
                                                F.col("embedding").cast("array<double>").alias("features"))
    # the number of vectors need not be a multiple of five
    out = P.aggregate_replicas(rows, "id", "label", "features", "vec_id", group_rows=5, short=True)
    return out.select("id", "grp", "label", F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


# --- by id -------------------------------------------------------------------------

def _component_rows(spark, sf):
    return global_index(view(spark, sf, "v_components"), ["vec_id", "feature_set", "replica"], "row")


_ABS = "-least({0}, 1.0::double - {0})"


def _id_pool(mode, agg):
    listed = ", ".join(d6(agg.format(p=p, l=_ABS.format(p)), p) for p in ("p_m", "p_k"))
    body = (f"select vec_id, {d6('p_m', 'p_m')}, {d6('p_k', 'p_k')} from v_components" if mode == "none" else
            f"select vec_id, {listed} from (select *, row_number() over (order by vec_id, feature_set, replica) as row from v_components) group by vec_id")
    @query(f"pool_by_id_{mode}", duck(body, "v_components"))
    def run(spark, sf):
        return P.pool_by_id(_component_rows(spark, sf), "vec_id", ["p_m", "p_k"], mode, "row").select("vec_id", r6("p_m"), r6("p_k"))


for _m, _agg in (("none", ""), ("avg", "avg({p})"), ("max", "max({p})"), ("xtrm", "arg_max({p}, {{'a': {l}, 'b': -row}})")):
    _id_pool(_m, _agg)


@query("pool_by_id_runs", f"""with i as (select event_type, least(value/100, 1) as p, row_number() over (order by ts, event_id) - 1 as row from events),
    s as (select *, case when lag(event_type) over (order by row) = event_type then null else row end as st from i),
    r as (select *, max(st) over (order by row) as run_start from s)
    select event_type, run_start, {d6("arg_max(p, {'a': " + _ABS.format('p') + ", 'b': -row})", 'p')} from r group by event_type, run_start""")
def pool_by_id_runs(spark, sf):
    # ids come back later; probabilities of exactly 0 and 1 occur
    rows = view(spark, sf, "events").select("event_type", "ts", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("p"))
    rows = global_index(rows, ["ts", "event_id"], "row")
    return P.pool_by_id(rows, "event_type", ["p"], "xtrm", "row").select("event_type", "run_start", r6("p"))


# --- ensemble ------------------------------------------------------------------------

@query("component_projection", duck(f"select vec_id as image, {d6('p1', 'p_m')}, {d6('p2', 'p_k')} from ({pooled_sql('avg')})", "v_logits"))
def component_projection(spark, sf):
    pooled = pooled_scores(spark, sf).withColumnRenamed("vec_id", "image")
    return K.component_projection(pooled).select("image", r6("p_m"), r6("p_k"))


def _assembly_sql(mode: str, labels: bool) -> str:
    bits = E.MODES[mode][0]
    rows = ", ".join(f"({c}, {f}, {k})" for c, combo in enumerate(E.combinations(mode)) for f, k in enumerate(combo))
    value = {p: (BITS.format(p) if bits else p) for p in ("p_m", "p_k")}
    label = "max(case when t.melanoma=1 then 1 when t.keratosis=1 then 2 else 0 end)" if labels else "0"
    join = "join v_truth t on t.vec_id = c.vec_id" if labels else ""
    wide = ", ".join(d6(f"max(case when f={i // 2} then {value[('p_m', 'p_k')[i % 2]]} end)", f"f{i}") for i in range(14))
    return (f"with combos(comb_id, f, k) as (values {rows}) select c.vec_id as image, comb_id, {label} as label, {wide} "
            f"from v_components c join combos on c.feature_set = f and c.replica = k {join} group by c.vec_id, comb_id")


def _assembly(key, mode, labels):
    @query(key, duck(_assembly_sql(mode, labels), "v_components", *(["v_truth"] if labels else [])))
    def run(spark, sf):
        comps = view(spark, sf, "v_components").withColumnRenamed("vec_id", "image")
        truth = view(spark, sf, "v_truth").withColumnRenamed("vec_id", "image") if labels else None
        out = E.assemble(comps, mode, "image", truth)
        return out.select("image", "comb_id", "label", *[r6(F.col("features")[i], f"f{i}") for i in range(14)])


_assembly("assemble_meta", "ALL_LOGITS", True)
_assembly("assemble_meta_logits", "LOGITS", True)
_assembly("assemble_meta_probs", "PROBS", False)
_assembly("assemble_meta_all_probs", "ALL_PROBS", False)


@query("assemble_ordered", duck(f"""select *, row_number() over (order by image, comb_id) - 1 as position from
    ({_assembly_sql("PROBS", False)})""", "v_components"))
def assemble_ordered(spark, sf):
    # written in order of image and combination, read back without a sort
    folder = scratch_path(spark, "ordered")
    comps = view(spark, sf, "v_components").withColumnRenamed("vec_id", "image")
    tables.write_ordered(E.assemble(comps, "PROBS", "image"), folder, ["image", "comb_id"])
    return tables.read_ordered(spark, folder).select("image", "comb_id", "label", *[r6(F.col("features")[i], f"f{i}") for i in range(14)], "position")


_GAPS = "not (feature_set = 0 and replica = 1 and p_m < 0.45) and not (feature_set = 3 and p_k > 0.55)"


@query("check_id_lists", duck(f"""with c as (select * from v_components where {_GAPS}), b as (select vec_id from c where feature_set=0 and replica=1),
    s as (select distinct feature_set, replica from c), ids as (select distinct vec_id from c),
    g as (select s.feature_set, s.replica, ids.vec_id, exists (select 1 from c where c.feature_set=s.feature_set and c.replica=s.replica and c.vec_id=ids.vec_id) as here,
      ids.vec_id in (select vec_id from b) as base from s, ids)
    select feature_set, replica, vec_id as image, case when here then 'extra' else 'missing' end as problem from g where here <> base""", "v_components"))
def check_id_lists(spark, sf):
    # predictions beyond a limit are left out, so that some lists have gaps
    comps = view(spark, sf, "v_components").filter(_GAPS).withColumnRenamed("vec_id", "image")
    return E.check_id_lists(comps)
