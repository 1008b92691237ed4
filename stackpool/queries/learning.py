"""Preprocessors, feature summaries, folds, linear SVMs, final submission."""

from pyspark.sql import functions as F

from stackpool.operators import ensemble as E
from stackpool.operators import features as X
from stackpool.operators import svm as V
from stackpool.plans import stack as K
from stackpool.queries.registry import d6, query, r6
from stackpool.queries.views import duck, view

N_FEATURES = 64
LONG = "select vec_id, label, unnest(embedding)::double as x, unnest(generate_series(0,63)) as pos from embeddings"


def rows(spark, sf):
    """Feature rows: id, label (three classes), features."""
    return view(spark, sf, "embeddings").select("vec_id", (F.col("label") % 3).alias("label"),
                                                F.col("embedding").cast("array<double>").alias("features"))


def _long(df):
    return df.select("vec_id", F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


@query("zscore_stats", f"select pos, {d6('avg(x)', 'mean')}, {d6('stddev_pop(x)', 'std')} from ({LONG}) group by pos")
def zscore_stats(spark, sf):
    return X.zscore_stats(rows(spark, sf), "features").select("pos", r6("mean"), r6("std"))


@query("preprocess_none", f"select vec_id, pos, {d6('x', 'x')} from ({LONG})")
def preprocess_none(spark, sf):
    return _long(X.fit_preprocessor(rows(spark, sf), "NONE").transform(rows(spark, sf)))


@query("preprocess_z_score", f"select vec_id, pos, {d6('(x - avg(x) over (partition by pos)) / stddev_pop(x) over (partition by pos)', 'x')} from ({LONG})")
def preprocess_z_score(spark, sf):
    df = rows(spark, sf)
    return _long(X.fit_preprocessor(df, "Z_SCORE").transform(df))


@query("preprocess_pca", f"""with c as (select vec_id, x - avg(x) over (partition by pos) as x from ({LONG}))
    select vec_id, {d6('sum(x*x)', 'squared_length')} from c group by vec_id""")
def preprocess_pca(spark, sf):
    # all components are kept, so the projection preserves the length of the centred row
    df = rows(spark, sf)
    out = X.fit_preprocessor(df, "PCA").transform(df)
    return out.select("vec_id", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x), "squared_length"))


def _reduced(m: str, d: int) -> str:
    """SQL: the matrix ``m`` (a list of d rows) after Gauss-Jordan elimination of its first d columns.

    A fold over matrices: each further one has a pivot's number in its only cell.
    """
    pivot = "(z[1][1] + 1)::int"
    return f"""list_reduce(list_prepend({m}, list_transform(range({d}), lambda k: [[k::double]])),
        lambda a, z: list_transform(a, lambda r, i: case when i = {pivot} then list_transform(r, lambda v: v / r[{pivot}])
            else list_transform(r, lambda v, j: v - r[{pivot}] * a[{pivot}][j] / a[{pivot}][{pivot}]) end))"""


_COVARIANCE = f"""c as (select vec_id, pos, x - avg(x) over (partition by pos) as x from ({LONG})),
    a as (select p.pos as i, q.pos as j, sum(p.x * q.x) / (count(*) - 1) as v from c p join c q using (vec_id) group by all)"""


@query("pca_moments", f"""with {_COVARIANCE}, b as (select l.i, r.j, sum(l.v * r.v) as v from a l join a r on l.j = r.i group by all)
    select 1 as power, {d6('(select sum(v) from a where i = j)', 'total')} union all select 2, {d6('(select sum(v) from b where i = j)')}
    union all select 3, {d6('(select sum(l.v * r.v) from a l join b r on l.i = r.j and l.j = r.i)')}""")
def pca_moments(spark, sf):
    """Sums of powers of the components' variances: those of the covariance's eigenvalues only if the axes are its eigenvectors."""
    df = rows(spark, sf)
    out = X.fit_preprocessor(df, "PCA").transform(df).select(F.posexplode("features").alias("pos", "x"))
    found = out.groupBy("pos").agg(F.variance("x").alias("v")).select("v", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("power"))
    return found.groupBy("power").agg(r6(F.sum(F.pow("v", F.col("power"))), "total"))


@query("preprocess_pca_whiten", f"""with {_COVARIANCE}, m as (select list(r order by i) as m from (select i, list_concat(list(v order by j), list_transform(range(64), lambda k: (k = i)::int::double)) as r from a group by i)),
    inv as (select list_transform({_reduced("m", 64)}, lambda r: r[65:]) as g from m),
    e as (select vec_id, list(x order by pos) as e from c group by vec_id)
    select vec_id, {d6('list_dot_product(e, list_transform(g, lambda r: list_dot_product(r, e)))', 'squared_length')} from e, inv""")
def preprocess_pca_whiten(spark, sf):
    # the squared length of a whitened row is its Mahalanobis distance, for axes along the eigenvectors alone
    df = rows(spark, sf)
    out = X.fit_preprocessor(df, "PCA_WHITEN").transform(df)
    return out.select("vec_id", r6(F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x), "squared_length"))


@query("pca_project")
def pca_project(spark, sf):
    """Every row in the axes of greatest variance."""
    df = rows(spark, sf)
    return X.fit_preprocessor(df, "PCA").transform(df).select("vec_id", F.posexplode("features").alias("pos", "x"))


@query("feature_sparsity", """select pos, """ + d6("avg(case when x = 0 then 1.0 else 0.0 end)", "zero_share") +
       """ from (select unnest([l_discount, l_tax, l_quantity - 1]) as x, unnest([0,1,2]) as pos from lineitem) group by pos""")
def feature_sparsity(spark, sf):
    df = view(spark, sf, "lineitem").select(F.array("l_discount", "l_tax", F.col("l_quantity") - 1).alias("f"))
    return X.feature_sparsity(df, "f").select("pos", r6("zero_share"))


@query("feature_histogram", f"select pos, cast(floor((x + 1) / 0.125) as bigint) as bin, count(*) as n from ({LONG}) group by 1, 2")
def feature_histogram(spark, sf):
    return X.feature_histogram(rows(spark, sf), "features", -1.0, 0.125)


@query("group_folds", "select l_orderkey, l_linenumber, cast(('0x' || substr(md5(concat('0:', cast(l_orderkey as string))),1,8))::ubigint % 3 as int) as fold from lineitem")
def group_folds(spark, sf):
    return V.group_folds(view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey")


@query("group_folds_balanced", """with n as (select l_orderkey, count(*) as n from lineitem group by 1),
    d as (select l_orderkey, cast((row_number() over (order by n desc, md5(concat('0:', cast(l_orderkey as string)))) - 1) % 3 as int) as fold from n)
    select l_orderkey, l_linenumber, fold from lineitem join d using (l_orderkey)""")
def group_folds_balanced(spark, sf):
    return V.group_folds(view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", method="balanced")


@query("stratified_folds", """select o_orderkey, o_orderstatus, cast((row_number() over (order by o_orderstatus, md5(concat('0:', cast(o_orderkey as string)))) - 1) % 3 as int) as fold from orders""")
def stratified_folds(spark, sf):
    return V.stratified_folds(view(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey")


_U = "('0x' || substr(md5(concat('0:{0}:', cast(trial as string))),1,8))::ubigint::double / 4294967296"


@query("trial_grid", f"""with n as (select floor(log2(1.0::double/count(*))) - 4 as low from lineitem), t as (select unnest(generate_series(0,29)) as trial)
    select cast(trial as int) as trial, {d6('pow(2, -16 + 32*' + _U.format('C') + ')', 'c')}, {d6('pow(2, low + (least(3, low+32) - low)*' + _U.format('gamma') + ')', 'gamma')} from t, n""")
def trial_grid(spark, sf):
    n = view(spark, sf, "lineitem").count()
    return V.trial_table(spark, 30, n).select("trial", r6("c"), r6("gamma"))


# ten Newton steps: the normal equations of the rows within the margin, solved by elimination
@query("svm_fit", f"""with recursive x as (select vec_id, label % 3 as label, list_append(list_transform(embedding, lambda v: v::double), 1.0::double) as e from embeddings),
    s(positive, c) as (values (1, 0.25::double), (1, 16.0::double), (2, 0.25::double), (2, 16.0::double)),
    it as (select 0 as k, positive, c, list_transform(range(65), lambda i: 0.0::double) as w from s
        union all
        select k, positive, c, list_transform({_reduced("m", 65)}, lambda r: r[66]) as w from (select k, positive, c, list(r order by i) as m from (
            select k, positive, c, i, list(v order by j) as r from (
                select k + 1 as k, positive, c, i, j, (i = j)::int + 2 * c * sum(e[i] * (case when j <= 65 then e[j] else y end)) as v from (
                    select k, positive, c, e, case when label = positive then 1.0::double else -1.0::double end as y from it, x
                    where k < 10 and (case when label = positive then 1 else -1 end) * list_dot_product(w, e) < 1),
                    (select unnest(range(1, 66)) as i), (select unnest(range(1, 67)) as j) group by k, positive, c, i, j) group by k, positive, c, i) group by k, positive, c))
    select positive, c, (generate_subscripts(w, 1) - 1)::int as pos, {d6('unnest(w)', 'weight')} from it where k = 10""")
def svm_fit(spark, sf):
    """All weights (the last one is the constant's) of both tasks for a weak and a strong penalty."""
    settings = [V.Setting(positive, c) for positive in V.TASKS.values() for c in (0.25, 16.0)]
    w = V.fit(rows(spark, sf), settings, N_FEATURES, tol=1e-11)
    listed = [(s.positive, s.c, pos, float(v)) for i, s in enumerate(settings) for pos, v in enumerate(w[:, i])]
    return spark.createDataFrame(listed, "positive int, c double, pos int, weight double").withColumn("weight", r6("weight"))


def _folded(spark, sf):
    return V.group_folds(rows(spark, sf).withColumn("id", F.floor(F.col("vec_id") / 5)), "id")


@query("svm_search")
def svm_search(spark, sf):
    """Trials, folds and held-out AUC of the random search for both tasks."""
    return V.random_search(_folded(spark, sf), N_FEATURES, trials=V.TRIALS)[0]


def _draw(text: str, word: int) -> str:
    return f"('0x' || substr(md5({text}), {8 * word + 1}, 8))::ubigint::double / 4294967296"


@query("rff_features", f"""with w as (select cast(i as int) as i, cast(j as int) as j, sqrt(-2 * ln({_draw("concat('0:rff:', i, ':', j)", 0)} + pow(2.0::double, -33)))
        * cos(2 * pi() * {_draw("concat('0:rff:', i, ':', j)", 1)}) as v from (select unnest(generate_series(0, 63)) as i), (select unnest(generate_series(0, 127)) as j)),
    b as (select cast(j as int) as j, 2 * pi() * {_draw("concat('0:phase:', j)", 0)} as v from (select unnest(generate_series(0, 127)) as j)),
    s as (select vec_id, w.j, sum(x * w.v) as s from ({LONG}) l join w on l.pos = w.i group by vec_id, w.j)
    select vec_id, j as pos, {d6('sqrt(2.0::double / 128) * cos(s + b.v)', 'x')} from s join b using (j)""")
def rff_features(spark, sf):
    """Gaussian-kernel random features of every row."""
    out = X.random_fourier(rows(spark, sf), "features", N_FEATURES, 128, 0.5)
    return out.select("vec_id", F.posexplode("features").alias("pos", "x")).withColumn("x", r6("x"))


# a fixed stack over the fourteen meta-features
WEIGHTS = {"melanoma": [((3 * i) % 7 - 3) / 4.0 for i in range(14)] + [0.125],
           "keratosis": [((5 * i) % 7 - 3) / 4.0 for i in range(14)] + [-0.25]}
FIXED_MODEL = V.StackModel(X.Preprocessor("NONE"), WEIGHTS, {"preprocess": "NONE"})


def _submission(key, pool, agg):
    combos = ", ".join(f"({c}, {f}, {k})" for c, combo in enumerate(E.ALL_COMBINATIONS) for f, k in enumerate(combo))
    bits = "log2(least(greatest({p}, 0.00001), 0.99999) / (1 - least(greatest({p}, 0.00001), 0.99999)))"

    def weight(w):
        m = " ".join(f"when {f} then {w[2 * f]}" for f in range(7))
        k = " ".join(f"when {f} then {w[2 * f + 1]}" for f in range(7))
        return f"sum(case f {m} end * {bits.format(p='p_m')} + case f {k} end * {bits.format(p='p_k')}) + {w[-1]}"
    listed = ", ".join(d6(agg.format(d=d, p=f"1/(1+exp(-{d}))"), p) for d, p in (("dm", "p_m"), ("dk", "p_k")))
    body = f"""with combos(comb_id, f, k) as (values {combos}), d as (select vec_id, comb_id, {weight(WEIGHTS['melanoma'])} as dm, {weight(WEIGHTS['keratosis'])} as dk
        from v_components c join combos on c.feature_set = f and c.replica = k group by vec_id, comb_id)
        select vec_id as image, {listed} from d group by vec_id"""

    @query(key, duck(body, "v_components"))
    def run(spark, sf):
        comps = view(spark, sf, "v_components").withColumnRenamed("vec_id", "image")
        meta = E.assemble(comps, "ALL_LOGITS", "image")
        return K.final_submission(meta, FIXED_MODEL, pool).select("image", r6("p_m"), r6("p_k"))


_submission("final_submission", "xtrm", "arg_max({p}, abs({d}))")
_submission("final_submission_avg", "avg", "avg({p})")


def _meta_rows(spark, sf):
    comps = view(spark, sf, "v_components").withColumnRenamed("vec_id", "image")
    return E.assemble(comps, "LOGITS", "image", view(spark, sf, "v_truth").withColumnRenamed("vec_id", "image"))


@query("train_stack_linear")
def train_stack_linear(spark, sf):
    """Meta-model over the fourteen meta-features, then its pooled submission."""
    meta = _meta_rows(spark, sf)
    model, _ = K.train_stack(meta, 14, "LINEAR_PRIMAL", "NONE")
    return K.final_submission(meta, model, "xtrm").select("image", "p_m", "p_k")


@query("train_stack_rbf")
def train_stack_rbf(spark, sf):
    """The same with whitening and random features of the Gaussian kernel."""
    meta = _meta_rows(spark, sf)
    model, _ = K.train_stack(meta, 14, "RBF", "PCA_WHITEN")
    return K.final_submission(meta, model, "avg").select("image", "p_m", "p_k")
