"""From six raw sources to placed training rows, integration and split in one query."""

from pyspark.sql import functions as F

from stackpool.operators import split as P
from stackpool.plans import dataset as D
from stackpool.plans import metadata as G
from stackpool.queries import metadata as Q
from stackpool.queries.registry import query
from stackpool.queries.splits import _SHARD, _SHARD_COLS, SPLIT
from stackpool.queries.views import duck, view

# rows of all sources in reading order; repeats keep their number
_TABLE = (f"{Q.Z_CHALLENGE}, {Q._union_sql('DEPLOY')}, {Q._SEEN}, numbered as (select *, row_number() over (order by source_no, line_no) - 1 as pos from e), "
          "v_meta as (select * exclude (prev, line_no, pos), pos as line_no from numbered where prev is null or prev <> image)")
_VIEWS = (*Q.RAWS, "v_listing", "v_neardup")


def _table(spark, sf):
    return G.integrate(Q._raw(spark, sf), view(spark, sf, "v_listing"), "DEPLOY", view(spark, sf, "v_neardup"))[0]


@query("deploy_split", duck(f"with {_TABLE}, {SPLIT} select image, case_id, stratum, line_no, split from final", *_VIEWS))
def deploy_split(spark, sf):
    return P.split_dataset(_table(spark, sf)).select("image", "case_id", "stratum", "line_no", "split")


# pictures that several sources share could be placed apart, which training_rows refuses: their first row stays
_FIRST = _TABLE.replace("v_meta as (", "v_all as (") + ", v_meta as (select * from v_all where line_no in (select min(line_no) from v_all group by image))"


@query("deploy_shards", duck(f"with {_FIRST}, {SPLIT}" + _SHARD.format(order="md5(concat('1:', image))", src="final", per=64, third=21), *_VIEWS))
def deploy_shards(spark, sf):
    rows = _table(spark, sf)
    first = rows.groupBy("image").agg(F.min("line_no").alias("line_no")).select("line_no")
    return D.training_rows(rows.join(first, "line_no", "left_semi"), per_shard=64).select(*_SHARD_COLS)
