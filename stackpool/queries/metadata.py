"""Source scans, normalisation, key checks and integration."""

from pyspark.sql import functions as F

from stackpool import schemas
from stackpool.functions import scores as S
from stackpool.functions.draws import shuffle_key
from stackpool.operators import joins as J
from stackpool.operators import normalise as N
from stackpool.operators.order import global_index
from stackpool.plans import metadata as G
from stackpool.queries import files
from stackpool.queries.registry import d6, query, r6
from stackpool.queries.views import duck, view
from stackpool.sources import text as T

META = [c for c in N.COMMON]
_META_COLS = ("image, case_id, type, age, cast(has_age as string) as has_age, sex, cast(has_sex as string) as has_sex, "
              "cast(melanoma as string) as melanoma, cast(keratosis as string) as keratosis, "
              "cast(schedule as string) as schedule, cast(weight as string) as weight, dataset")


# --- scans: tables written as text files, then read back ------------------------

@query("scan_metadata", duck(f"select {_META_COLS} from v_meta", "v_meta"))
def scan_metadata(spark, sf):
    path = files.text_folder(view(spark, sf, "v_meta").select(*META), "metadata")
    return T.scan_metadata(spark, path)


@query("scan_tsv", duck("select " + ", ".join(f"f{i}" for i in range(12)) + " from raw_atlas", "raw_atlas"))
def scan_tsv(spark, sf):
    path = files.text_folder(view(spark, sf, "raw_atlas").drop("line_no"), "atlas", sep="\t")
    return T.scan_tsv(spark, path, schemas.ATLAS)


@query("scan_predictions", duck(f"select cast(vec_id as string) as image, {d6('p_m', 'p_m')}, {d6('p_k', 'p_k')} from v_pred1", "v_pred1"))
def scan_predictions(spark, sf):
    path = files.text_folder(view(spark, sf, "v_pred1").select("vec_id", "p_m", "p_k"), "predictions", header=False)
    return T.scan_predictions(spark, path).select("image", r6("p_m"), r6("p_k"))


@query("scan_truth", duck("select cast(vec_id as string) as image, melanoma, keratosis from v_truth", "v_truth"))
def scan_truth(spark, sf):
    rows = view(spark, sf, "v_truth").select("vec_id", *[F.col(c).cast("double").alias(c) for c in ("melanoma", "keratosis")])
    return T.scan_truth(spark, files.text_folder(rows, "truth"))


@query("scan_blacklist", duck("select image from v_blacklist union all select ''", "v_blacklist"))
def scan_blacklist(spark, sf):
    # a blank line is an entry of its own
    rows = view(spark, sf, "v_blacklist").unionByName(spark.range(1).select(F.lit("").alias("image")))
    return T.scan_keys(spark, files.text_folder(rows, "blacklist", header=False))


@query("scan_neardup", """select cast(user_id as string) as image, arg_max(concat('case_', cast(event_id as string)), event_id) as case_id
    from events group by user_id""")
def scan_neardup(spark, sf):
    # a user's lines stay together and in order, the last one wins
    rows = (view(spark, sf, "events").repartition("user_id").sortWithinPartitions("user_id", "event_id")
            .select("user_id", F.concat(F.lit("case_"), "event_id").alias("case_id")))
    return T.scan_key_values(spark, files.text_folder(rows, "neardup", header=False))


@query("scan_json_meta", duck("""select concat('D', cast(doc_id as string)) as image, case when n_chars%7=0 then null else lang end as benign_malignant,
    case when n_chars%11=0 then null else source end as diagnosis, cast(null as string) as diagnosis_confirm_type,
    case when n_chars%11=0 then null else cast(n_chars%90 as string) end as age_approx, cast(null as string) as sex from documents"""))
def scan_json_meta(spark, sf):
    # one file per document; clinical fields, whole levels and nulls are absent in turn
    clinical = F.struct(F.when(F.col("n_chars") % 7 != 0, F.col("lang")).alias("benign_malignant"),
                        F.col("source").alias("diagnosis"), (F.col("n_chars") % 90).alias("age_approx"))
    docs = view(spark, sf, "documents").select(
        F.concat(F.lit("D"), "doc_id", F.lit(".v1.json")).alias("name"),
        F.when(F.col("n_chars") % 11 != 0, F.to_json(F.struct(F.struct(clinical.alias("clinical")).alias("meta"))))
        .when(F.col("n_chars") % 7 != 0, F.to_json(F.struct(F.struct(F.struct(F.col("lang").alias("benign_malignant")).alias("clinical")).alias("meta"))))
        .otherwise('{"meta": {}}').cast("binary").alias("content"))
    return T.scan_clinical(spark, files.files_in_folders(docs, "json"))


@query("filter_masks", "select page_id, url from pages where not regexp_matches(url, 'en|superpixel')")
def filter_masks(spark, sf):
    return T.drop_masks(view(spark, sf, "pages").select("page_id", "url"), "url", "en|superpixel")


# --- normalisation ----------------------------------------------------------------

_AGE = "case when {0} = '{1}' then '' else {0} end"
_HAS = "case when {0} = '{1}' then 0 else 1 end"


def _sql(source: str, dataset: str, where: str = "", **cols) -> str:
    base = {"image": "image", "case_id": "''", "type": "'d'", "age": "''", "has_age": "0", "sex": "''", "has_sex": "0",
            "melanoma": "0", "keratosis": "0", "schedule": "1", "weight": "1", **cols}
    listed = ", ".join(f"cast({v} as double) as {k}" if k in ("schedule", "weight") else f"{v} as {k}" for k, v in base.items())
    return f"select {listed}, '{dataset}' as dataset, line_no from {source} {where}"


NORMAL = {
    "atlas": _sql("raw_atlas", "atlas", image="f1", case_id="upper(f2)", type="lower(substr(f0,1,1))",
                  age="case when f7='1' then f6 else '' end", has_age="cast(f7 as int)", sex="case when f9='1' then f8 else '' end",
                  has_sex="cast(f9 as int)", melanoma="cast(f4 as int)", keratosis="cast(f5 as int)", schedule="f10", weight="f11"),
    "archive": _sql("raw_archive", "isic", age=_AGE.format("age_approx", "None"), has_age=_HAS.format("age_approx", "None"),
                    sex=_AGE.format("sex", "None"), has_sex=_HAS.format("sex", "None"),
                    melanoma="case when diagnosis='melanoma' then 1 else 0 end",
                    keratosis="case when diagnosis='seborrheic keratosis' then 1 else 0 end", schedule="2",
                    weight="case diagnosis_confirm_type when 'histopathology' then 3 when 'single image expert consensus' then 2 else 1 end"),
    "challenge": _sql("z_challenge", "challenge", age=_AGE.format("age", "unknown"), has_age=_HAS.format("age", "unknown"),
                      sex=_AGE.format("sex", "unknown"), has_sex=_HAS.format("sex", "unknown"),
                      melanoma="cast(cast(melanoma as double) as int)", keratosis="cast(cast(keratosis as double) as int)",
                      schedule="2", weight="5"),
    "irma": _sql("raw_irma", "irma", melanoma="1"),
    "ph2": _sql("raw_ph2", "ph2", melanoma="case when length(melanoma)>0 then 1 else 0 end", weight="case when length(histology)>0 then 3 else 1 end"),
    "dermofit": _sql("raw_dermofit", "dermofit", melanoma="case when diagnosis='MEL' then 1 else 0 end", keratosis="case when diagnosis='SK' then 1 else 0 end"),
}
Z_CHALLENGE = ("z_challenge as (select m.image, m.age, m.sex, t.melanoma, t.keratosis, m.line_no from raw_challenge_meta m "
               "join raw_challenge_truth t on m.line_no = t.line_no where m.image = t.image)")
KEEP = {"archive": "diagnosis not in ('atypical melanocytic proliferation','other','None') and age_approx <> '15'",
        "irma": "melanoma = '1'", "ph2": "length(atypical_nevus) = 0"}
RAWS = ["raw_atlas", "raw_archive", "raw_challenge_meta", "raw_challenge_truth", "raw_irma", "raw_ph2", "raw_dermofit"]


def _challenge(spark, sf):
    return G.zip_challenge(view(spark, sf, "raw_challenge_meta"), view(spark, sf, "raw_challenge_truth"))


def _raw(spark, sf):
    return {"atlas": view(spark, sf, "raw_atlas"), "archive": view(spark, sf, "raw_archive"), "challenge": _challenge(spark, sf)[0],
            "irma": view(spark, sf, "raw_irma"), "ph2": view(spark, sf, "raw_ph2"), "dermofit": view(spark, sf, "raw_dermofit")}


def _norm(name, fn):
    views = ["raw_challenge_meta", "raw_challenge_truth"] if name == "challenge" else [f"raw_{name}"]
    body = f"with {Z_CHALLENGE} {NORMAL[name]}" if name == "challenge" else NORMAL[name]

    @query(f"norm_{name}", duck(body, *views))
    def run(spark, sf):
        return fn(_challenge(spark, sf)[0] if name == "challenge" else view(spark, sf, f"raw_{name}"))


for _name, _fn in (("atlas", N.norm_atlas), ("archive", N.norm_archive), ("challenge", N.norm_challenge),
                   ("irma", N.norm_irma), ("ph2", N.norm_ph2), ("dermofit", N.norm_dermofit)):
    _norm(_name, _fn)


def _filtered(name, fn):
    @query(f"filter_{name}", duck(f"select * from raw_{name} where {KEEP[name]}", f"raw_{name}"))
    def run(spark, sf):
        return fn(view(spark, sf, f"raw_{name}"))


for _name, _fn in (("archive", N.filter_archive), ("irma", N.filter_irma), ("ph2", N.filter_ph2)):
    _filtered(_name, _fn)


@query("norm_test", duck(f"""select image, '' as case_id, 'd' as type, {_AGE.format('age', 'unknown')} as age, {_HAS.format('age', 'unknown')} as has_age,
    {_AGE.format('sex', 'unknown')} as sex, {_HAS.format('sex', 'unknown')} as has_sex, 0 as melanoma, 0 as keratosis,
    0.0::double as schedule, 0.0::double as weight, coalesce(lag(image) over (order by line_no), '') = image as duplicate, line_no
    from v_meta_test""", "v_meta_test"))
def norm_test(spark, sf):
    return N.norm_test(view(spark, sf, "v_meta_test"))


@query("label3", duck("select image, case when melanoma=1 then 1 when keratosis=1 then 2 else 0 end as label from v_meta", "v_meta"))
def label3(spark, sf):
    return view(spark, sf, "v_meta").select("image", S.label3("melanoma", "keratosis").alias("label"))


@query("encode_record", duck("""select image, case_id, cast(case when melanoma=1 then 1 when keratosis=1 then 2 else 0 end as bigint) as label,
    cast(melanoma as bigint) as melanoma, cast(keratosis as bigint) as keratosis, case when type='d' then 1.0 else 0.0 end::float as type,
    coalesce(try_cast(age as float), 0) as age, has_age::float as has_age, case when sex='female' then 1.0 else 0.0 end::float as sex,
    has_sex::float as has_sex, schedule::float as schedule, weight::float as weight from v_meta""", "v_meta"))
def encode_record(spark, sf):
    return N.encode_record(view(spark, sf, "v_meta"))


_CLIN = """select event_id, event_type as diagnosis, case when user_id%3=0 then null else cast(user_id%90 as string) end as age_approx,
    case when user_id%4=0 then null else 'female' end as sex from events"""


def _clinical(spark, sf):
    return N.extract_clinical(view(spark, sf, "v_clinical"), "doc", ("diagnosis", "age_approx", "sex")).select(
        "event_id", "diagnosis", "age_approx", "sex")


@query("json_extract", _CLIN)
def json_extract(spark, sf):
    return _clinical(spark, sf)


@query("null_to_none", f"select event_id, coalesce(diagnosis,'None') as diagnosis, coalesce(age_approx,'None') as age_approx, coalesce(sex,'None') as sex from ({_CLIN})")
def null_to_none(spark, sf):
    return N.null_to_none(_clinical(spark, sf), ["diagnosis", "age_approx", "sex"])


@query("nonnull_counts", f"select count(*) as images, count(diagnosis) as diagnosis, count(age_approx) as age_approx, count(sex) as sex from ({_CLIN})")
def nonnull_counts(spark, sf):
    return N.nonnull_counts(_clinical(spark, sf), ["diagnosis", "age_approx", "sex"])


@query("distinct_sets", f"""select distinct 'diagnosis' as field, coalesce(diagnosis,'None') as value from ({_CLIN}) union all
    select distinct 'age_approx', coalesce(age_approx,'None') from ({_CLIN}) union all select distinct 'sex', coalesce(sex,'None') from ({_CLIN})""")
def distinct_sets(spark, sf):
    return N.distinct_values(_clinical(spark, sf), ["diagnosis", "age_approx", "sex"])


# --- joins and sets -----------------------------------------------------------------

@query("join_neardup", duck("select m.image, coalesce(n.case_id, '') as case_id, m.line_no from v_meta m left join v_neardup n on m.image = n.image", "v_meta", "v_neardup"))
def join_neardup(spark, sf):
    return J.with_case(view(spark, sf, "v_meta"), view(spark, sf, "v_neardup")).select("image", "case_id", "line_no")


@query("join_exists", duck("select image, line_no from v_meta where image in (select image from v_listing)", "v_meta", "v_listing"))
def join_exists(spark, sf):
    return J.keep_existing(view(spark, sf, "v_meta").select("image", "line_no"), view(spark, sf, "v_listing"))


@query("report_missing", duck("select image, line_no from v_meta where image not in (select image from v_listing)", "v_meta", "v_listing"))
def report_missing(spark, sf):
    return J.missing(view(spark, sf, "v_meta").select("image", "line_no"), view(spark, sf, "v_listing"))


@query("anti_blacklist", duck("select image, line_no from v_meta where image not in (select image from v_blacklist)", "v_meta", "v_blacklist"))
def anti_blacklist(spark, sf):
    return J.missing(view(spark, sf, "v_meta").select("image", "line_no"), view(spark, sf, "v_blacklist"))


@query("semi_set", duck("select image, case_id from v_meta where image not in (select image from v_listing)", "v_meta", "v_listing"))
def semi_set(spark, sf):
    return J.missing(view(spark, sf, "v_meta").select("image", "case_id"), view(spark, sf, "v_listing"), "image")


@query("new_files", "select o_orderkey, o_orderdate::varchar as day from orders where o_orderkey not in (select l_orderkey from lineitem)")
def new_files(spark, sf):
    now = view(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("day"))
    return J.missing(now, view(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


@query("zip_join", duck("""select m.line_no, m.image, m.age, t.melanoma from raw_challenge_meta m join
    raw_challenge_truth t on m.line_no = t.line_no where m.image = t.image""", "raw_challenge_meta", "raw_challenge_truth"))
def zip_join(spark, sf):
    return _challenge(spark, sf)[0].select("line_no", "image", "age", "melanoma")


@query("zip_mismatch", """with a as (select row_number() over (order by doc_id) - 1 as line_no, doc_id as image from documents),
    b as (select row_number() over (order by doc_id) - 1 as line_no, doc_id as truth_image from labels)
    select a.line_no, image, truth_image from a join b on a.line_no = b.line_no where image <> truth_image""")
def zip_mismatch(spark, sf):
    # the two sides have different lengths and drift apart
    left = global_index(view(spark, sf, "documents").select(F.col("doc_id").alias("image")), ["image"], "line_no")
    right = global_index(view(spark, sf, "labels").select(F.col("doc_id").alias("truth_image")), ["truth_image"], "line_no")
    return J.zip_by_line(left, right, "image", "truth_image")[1]


# --- order and integration -------------------------------------------------------------

@query("dedup_adjacent", """select event_id, event_type from (select event_id, event_type, lag(event_type) over (order by ts, event_id) as p from events)
    where p is null or p <> event_type""")
def dedup_adjacent(spark, sf):
    # few distinct values, each of them very frequent
    return G.dedup_adjacent(view(spark, sf, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"],
                            "event_type")[0].select("event_id", "event_type")


@query("shuffle", "select doc_id, row_number() over (order by md5(concat('0:', cast(doc_id as string))), doc_id) - 1 as pos from documents")
def shuffle(spark, sf):
    return global_index(view(spark, sf, "documents").select("doc_id"), [shuffle_key(0, "doc_id"), "doc_id"], "pos")


def _union_sql(mode: str) -> str:
    parts = []
    for i, name in enumerate(G.SOURCES):
        sql = NORMAL[name]
        if mode != "ALL" and name in KEEP:
            sql += f" where {KEEP[name]}"
        parts.append(f"select *, {i} as source_no from ({sql})")
    union = "u0 as (" + " union all ".join(parts) + ")"
    if mode == "DEPLOY":
        return union + (", u as (select u0.* replace (case when dataset='atlas' then u0.case_id else coalesce(n.case_id,'') end as case_id) "
                        "from u0 left join v_neardup n on u0.image = n.image)")
    return union + ", u as (select * from u0)"


_SEEN = ("e as (select *, lag(image) over (order by source_no, line_no) as prev from u where image in (select image from v_listing))")


def _integration(key: str, mode: str):
    @query(key, duck(f"""with {Z_CHALLENGE}, {_union_sql(mode)}, {_SEEN}
        select * exclude (prev) from e where prev is null or prev <> image""", *RAWS, "v_listing", "v_neardup"))
    def run(spark, sf):
        near = view(spark, sf, "v_neardup") if mode == "DEPLOY" else None
        out = G.integrate(_raw(spark, sf), view(spark, sf, "v_listing"), mode, near)[0]
        # line numbers of the sources
        return out.drop("line_no").withColumnRenamed("source_line", "line_no")


_integration("integrate_sources", "DEPLOY")
_integration("integrate_sources_challenge", "CHALLENGE")
_integration("integrate_sources_all", "ALL")


@query("rejects", duck(f"""with {Z_CHALLENGE}, {_union_sql('DEPLOY')}, {_SEEN}
    select image, dataset, line_no, 'duplicate' as reason from e where prev = image union all
    select image, dataset, line_no, 'missing' from u where image not in (select image from v_listing) union all
    select m.image, 'challenge', m.line_no, 'mismatched' from raw_challenge_meta m join raw_challenge_truth t on m.line_no = t.line_no
    where m.image <> t.image""", *RAWS, "v_listing", "v_neardup"))
def rejects(spark, sf):
    return G.integrate(_raw(spark, sf), view(spark, sf, "v_listing"), "DEPLOY", view(spark, sf, "v_neardup"),
                       _challenge(spark, sf)[1])[1]
