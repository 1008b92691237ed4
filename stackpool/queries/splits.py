"""Strata, splits, shards and leakage checks."""

from pyspark.sql import functions as F

from stackpool.operators import split as P
from stackpool.plans import dataset as D
from stackpool.queries.registry import query
from stackpool.queries.views import duck, view

STRATA = """s as (select *, 'melanoma' as stratum from v_meta where melanoma=1 union all
    select *, 'keratosis' from v_meta where keratosis=1 union all
    select *, 'other' from v_meta where melanoma<>1 and keratosis<>1)"""
SPLIT = STRATA + """, f as (select *, row_number() over (partition by stratum, case_id order by line_no) as k from s),
    reps as (select * exclude (k) from f where case_id='' or k=1),
    ranked as (select *, row_number() over (partition by stratum order by md5(concat('0:', image)), line_no) - 1 as r,
        count(*) over (partition by stratum) as n from reps),
    placed as (select * exclude (r, n), case when r < floor(n/100.0::double*85) then 'train'
        when r < floor(n/100.0::double*85) + floor(n/100.0::double*15) then 'validation' else 'test' end as split from ranked),
    cs as (select case_id, max(case split when 'test' then 2 when 'validation' then 1 else 0 end) as p from placed where case_id<>'' group by case_id),
    extras as (select f.* exclude (k), case cs.p when 2 then 'test' when 1 then 'validation' else 'train' end as split
        from f join cs on f.case_id = cs.case_id where f.k > 1),
    final as (select * from placed union all select * from extras)"""


@query("strata", duck(f"with {STRATA} select image, line_no, stratum from s", "v_meta"))
def strata(spark, sf):
    return P.strata(view(spark, sf, "v_meta")).select("image", "line_no", "stratum")


@query("class_counts", duck(f"with {STRATA} select stratum, count(*) as n from s group by stratum", "v_meta"))
def class_counts(spark, sf):
    return P.class_counts(view(spark, sf, "v_meta"))


@query("split", duck(f"with {SPLIT} select image, case_id, stratum, line_no, split from final", "v_meta"))
def split(spark, sf):
    return P.split_dataset(view(spark, sf, "v_meta")).select("image", "case_id", "stratum", "line_no", "split")


@query("split_orders", """with z as (select o_orderkey, case when o_orderpriority='1-URGENT' then 'melanoma' when o_orderpriority='2-HIGH' then 'keratosis' else 'other' end as stratum from orders),
    t as (select o_orderkey, stratum, row_number() over (partition by stratum order by md5(concat('0:', cast(o_orderkey as string))), o_orderkey) - 1 as r, count(*) over (partition by stratum) as n from z)
    select o_orderkey, stratum, case when r < floor(n/100.0::double*70) then 'train' when r < floor(n/100.0::double*70)+floor(n/100.0::double*20) then 'validation' else 'test' end as split from t""")
def split_orders(spark, sf):
    # no cases, other percentages, on the larger orders table
    o = view(spark, sf, "orders").select(
        F.col("o_orderkey").alias("image"), F.lit("").alias("case_id"), F.col("o_orderkey").alias("line_no"),
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("melanoma"),
        (F.col("o_orderpriority") == "2-HIGH").cast("int").alias("keratosis"))
    return P.split_dataset(o, train=70, validation=20).select(F.col("image").alias("o_orderkey"), "stratum", "split")


@query("split_counts", duck(f"with {SPLIT} select split, count(*) as n from final group by split", "v_meta"))
def split_counts(spark, sf):
    return P.split_counts(P.split_dataset(view(spark, sf, "v_meta")))


_SHARD = """, g as (select *, row_number() over (partition by split order by {order}, line_no) - 1 as pos, count(*) over (partition by split) as n from {src}),
    h as (select *, case when n % {per} < {third} then greatest(ceil(n/{per}.0)-1, 1) else ceil(n/{per}.0) end as ns from g)
    select image, line_no, split, cast(pos as bigint) as pos, cast(ns as int) as num_shards, cast(least(pos // {per}, ns-1) as int) as shard,
    format('skin_lesions_{{}}_{{:05d}}-of-{{:05d}}', split, cast(least(pos // {per}, ns-1) as int) + 1, cast(ns as int)) as file from h"""
_SHARD_COLS = ("image", "line_no", "split", "pos", "num_shards", "shard", "file")


@query("shards", duck(f"with {SPLIT}" + _SHARD.format(order="md5(concat('1:', image))", src="final", per=64, third=21), "v_meta"))
def shards(spark, sf):
    return D.training_rows(view(spark, sf, "v_meta"), per_shard=64).select(*_SHARD_COLS)


@query("test_shards", duck("with final as (select *, 'test' as split from v_meta where image not in (select image from v_blacklist))"
                           + _SHARD.format(order="line_no", src="final", per=128, third=42), "v_meta", "v_blacklist"))
def test_shards(spark, sf):
    return D.test_rows(view(spark, sf, "v_meta"), view(spark, sf, "v_blacklist"), per_shard=128).select(*_SHARD_COLS)


@query("check_contamination", """select o_custkey, min(o_orderstatus) as first_split, max(o_orderstatus) as last_split from orders group by o_custkey
    having min(o_orderstatus) <> max(o_orderstatus)""")
def check_contamination(spark, sf):
    rows = view(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("split"))
    return P.contaminated(rows, "o_custkey")


@query("check_case_contamination", duck("""select case_id, min(dataset) as first_split, max(dataset) as last_split from v_meta where case_id <> ''
    group by case_id having min(dataset) <> max(dataset)""", "v_meta"))
def check_case_contamination(spark, sf):
    return P.contaminated(view(spark, sf, "v_meta").select("case_id", F.col("dataset").alias("split")), "case_id")
