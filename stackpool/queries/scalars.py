"""Scalar and array functions."""

from pyspark.sql import functions as F

from stackpool.functions import scores as S
from stackpool.queries.registry import d6, query, r6
from stackpool.queries.views import duck, view

BITS = "log2(least(greatest({0}, 0.00001), 0.99999) / (1 - least(greatest({0}, 0.00001), 0.99999)))"
SOFT = "exp({z} - greatest(z0,z1,z2)) / (exp(z0 - greatest(z0,z1,z2)) + exp(z1 - greatest(z0,z1,z2)) + exp(z2 - greatest(z0,z1,z2)))"
P = [SOFT.format(z=f"z{i}") for i in range(3)]
ARGMAX = "case when {0} >= {1} and {0} >= {2} then 0 when {1} >= {2} then 1 else 2 end"


def _logits(spark, sf):
    return view(spark, sf, "v_logits").withColumn("logits", F.array("z0", "z1", "z2"))


@query("bits_from_prob", duck(f"""select vec_id, feature_set, replica, {d6(BITS.format('cast(p_m as double)'), 'bits_m')},
    {d6(BITS.format('(p_k*3-1)'), 'bits_k')} from v_components""", "v_components"))
def bits_from_prob(spark, sf):
    # the second column leaves 0..1, so both clips take effect
    return view(spark, sf, "v_components").select(
        "vec_id", "feature_set", "replica", r6(S.bits_from_prob("p_m"), "bits_m"),
        r6(S.bits_from_prob(F.col("p_k") * 3 - 1), "bits_k"))


@query("sigmoid", f"""select event_id, {d6('1/(1+exp(-((value-100)*10)))', 'p')} from events""")
def sigmoid(spark, sf):
    # arguments run into the thousands
    return view(spark, sf, "events").select("event_id", r6(S.sigmoid((F.col("value") - 100) * 10), "p"))


@query("logit", f"""with p as (select event_id, least(value/100, 1) as p from events)
    select event_id, case when p <= 0 then -1000.0 when p >= 1 then 1000.0 else {d6('ln(p/(1-p))')} end as logit from p""")
def logit(spark, sf):
    # 0 and 1 occur; infinities are shown as +-1000
    p = F.least(F.col("value") / 100, F.lit(1.0))
    return view(spark, sf, "events").select("event_id", r6(F.least(F.greatest(S.logit(p), F.lit(-1000.0)), F.lit(1000.0)), "logit"))


@query("softmax", duck(f"select vec_id, replica, {', '.join(d6(p, f'p{i}') for i, p in enumerate(P))} from v_logits", "v_logits"))
def softmax(spark, sf):
    return _logits(spark, sf).withColumn("p", S.softmax("logits", 3)).select(
        "vec_id", "replica", *[r6(F.col("p")[i], f"p{i}") for i in range(3)])


@query("argmax_class", duck(f"select vec_id, replica, {ARGMAX.format('z0', 'z1', 'z2')} as prediction from v_logits", "v_logits"))
def argmax_class(spark, sf):
    return _logits(spark, sf).select("vec_id", "replica", S.argmax("logits").alias("prediction"))


@query("label_offset", "select vec_id, label - 1 as label from embeddings")
def label_offset(spark, sf):
    return view(spark, sf, "embeddings").select("vec_id", S.label_offset("label", 1).alias("label"))


@query("one_hot", "select vec_id, case when label%3=0 then 1.0 else 0.0 end::double as h0, case when label%3=1 then 1.0 else 0.0 end::double as h1, "
       "case when label%3=2 then 1.0 else 0.0 end::double as h2 from embeddings")
def one_hot(spark, sf):
    return view(spark, sf, "embeddings").withColumn("h", S.one_hot(F.col("label") % 3, 3)).select(
        "vec_id", *[F.col("h")[i].alias(f"h{i}") for i in range(3)])


@query("binarize", "select vec_id, case when label%3=1 then 1 else 0 end as melanoma, case when label%3=2 then 1 else 0 end as keratosis from embeddings")
def binarize(spark, sf):
    label = F.col("label") % 3
    return view(spark, sf, "embeddings").select("vec_id", S.binarize(label, 1).alias("melanoma"), S.binarize(label, 2).alias("keratosis"))


@query("append_scores", duck(f"""select e.vec_id, t.pos, {d6('case when t.pos < 64 then e.embedding[least(t.pos, 63) + 1] when t.pos = 64 then p.p_m else p.p_k end', 'x')}
    from embeddings e join v_pred1 p on e.vec_id = p.vec_id, (select unnest(generate_series(0, 65)) as pos) t""", "v_pred1"))
def append_scores(spark, sf):
    both = view(spark, sf, "embeddings").join(view(spark, sf, "v_pred1"), "vec_id")
    out = both.withColumn("f", S.append_scores(F.col("embedding").cast("array<double>"), F.array("p_m", "p_k")))
    return out.select("vec_id", F.posexplode("f").alias("pos", "x")).withColumn("x", r6("x"))


@query("format_scores", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, printf('%.16f', l_discount) as discount, printf('%.16f', l_extendedprice) as price from lineitem")
def format_scores(spark, sf):
    return view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                              S.format_score("l_discount").alias("discount"),
                                              S.format_score("l_extendedprice").alias("price"))


_W = [((7 * i) % 11 - 5) / 8.0 for i in range(64)]


@query("linear_score", "select vec_id, " + d6(" + ".join(f"embedding[{i + 1}]::double * ({w})" for i, w in enumerate(_W)) + " + 0.25", "score") + " from embeddings")
def linear_score(spark, sf):
    return view(spark, sf, "embeddings").select("vec_id", r6(S.linear_score(F.col("embedding").cast("array<double>"), _W, 0.25), "score"))


@query("cross_entropy", duck(f"""select truth, {d6('avg(0.9*(lse - zt) + 0.1/3*(3*lse - z0 - z1 - z2))', 'main')},
    {d6('avg(0.9*(lse - zt) + 0.1/3*(3*lse - z0 - z1 - z2)) + 0.4*avg(lse2 - zt/2)', 'total')}
    from (select *, case truth when 0 then z0 when 1 then z1 else z2 end as zt, ln(exp(z0)+exp(z1)+exp(z2)) as lse,
    ln(exp(z0/2)+exp(z1/2)+exp(z2/2)) as lse2 from v_logits) group by truth""", "v_logits"))
def cross_entropy(spark, sf):
    # the auxiliary head, weight 0.4, sees halved logits and no smoothing
    df = _logits(spark, sf)
    main = F.avg(S.cross_entropy("logits", "truth", 3, smoothing=0.1))
    aux = F.avg(S.cross_entropy(F.transform("logits", lambda z: z / 2), "truth", 3))
    return df.groupBy("truth").agg(r6(main, "main"), r6(main + 0.4 * aux, "total"))


@query("norm_filename", "select page_id, regexp_replace(lower(regexp_extract(url, '([^/]*)$', 1)), '\\.[^.]*$', '') || '.jpg' as file, "
       "split_part(regexp_extract(url, '([^/]*)$', 1), '.', 1) as stem from pages")
def norm_filename(spark, sf):
    return view(spark, sf, "pages").select("page_id", S.normal_filename("url").alias("file"), S.file_stem("url").alias("stem"))


@query("sql_functions", duck(f"""select vec_id, replica, {d6('1/(1+exp(-z0))', 's')}, {d6(BITS.format('(1/(1+exp(-z1)))'), 'b')},
    {d6(P[2], 'p2')} from v_logits""", "v_logits"))
def sql_functions(spark, sf):
    S.register_sql(spark)
    return spark.sql("""select vec_id, replica, round(sigmoid(z0), 6) + 0D as s, round(bits_from_prob(sigmoid(z1)), 6) + 0D as b,
        round(softmax(array(z0, z1, z2))[2], 6) + 0D as p2 from {v}""", v=view(spark, sf, "v_logits"))
