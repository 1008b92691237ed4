"""Stand-in source tables derived from the given ones.

A view is one SQL text over the given tables; texts that need engine-specific
syntax come as a (Spark, other) pair.  ``{name}`` stands for a table or view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stackpool.queries.registry import table

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

_IMG = "concat('IMG_', lpad(cast({} as string), 7, '0'))"
_D = _IMG.format("d.doc_id")
# a repeat of the picture before it, on lines picked by text length
_REP = _IMG.format("case when d.n_chars % 5 = 0 and d.doc_id > 0 then d.doc_id - 1 else d.doc_id end")
_FROM = "from {documents} d left join {labels} l on d.doc_id = l.doc_id"

VIEWS: dict[str, str | tuple[str, str]] = {
    "v_meta": f"""select {_D} as image,
        case when d.doc_id % 3 = 0 then '' else concat(d.source, '_', cast(d.doc_id % 7 as string)) end as case_id,
        case when d.doc_id % 5 = 0 then 'c' else 'd' end as type,
        case when d.n_chars % 7 = 0 then '' else cast(d.n_chars % 90 as string) end as age,
        case when d.n_chars % 7 = 0 then 0 else 1 end as has_age,
        case d.lang when 'en' then 'female' when 'fr' then 'male' else '' end as sex,
        case when d.lang in ('en','fr') then 1 else 0 end as has_sex,
        coalesce(l.toxic, 0) as melanoma, case when l.quality = 0 and l.toxic = 0 then 1 else 0 end as keratosis,
        d.n_chars % 3 as schedule, d.n_chars % 4 + 1 as weight, d.lang as dataset, d.doc_id as line_no {_FROM}""",
    "v_meta_test": f"""select {_REP} as image, case when d.n_chars % 7 = 0 then 'unknown' else cast(d.n_chars % 90 as string) end as age,
        case d.lang when 'en' then 'female' when 'fr' then 'male' else 'unknown' end as sex, d.doc_id as line_no from {{documents}} d""",
    "raw_atlas": f"""select case when d.doc_id % 5 = 0 then 'Clinical' else 'Dermoscopic' end as f0, {_REP} as f1,
        lower(concat(d.source, '_', cast(d.doc_id % 7 as string))) as f2, d.lang as f3, cast(coalesce(l.toxic, 0) as string) as f4,
        case when l.quality = 0 and l.toxic = 0 then '1' else '0' end as f5, cast(d.n_chars % 90 as string) as f6,
        case when d.n_chars % 7 = 0 then '0' else '1' end as f7, case when d.lang = 'en' then 'female' else 'male' end as f8,
        case when d.lang in ('en','fr') then '1' else '0' end as f9, cast(d.n_chars % 3 as string) as f10,
        cast(d.n_chars % 4 + 1 as string) as f11, d.doc_id as line_no {_FROM}""",
    "raw_archive": f"""select {_REP} as image, case when l.toxic = 1 then 'malignant' when l.toxic = 0 then 'benign' else 'None' end as benign_malignant,
        case d.n_chars % 7 when 0 then 'melanoma' when 1 then 'seborrheic keratosis' when 2 then 'nevus'
          when 3 then 'atypical melanocytic proliferation' when 4 then 'other' when 5 then 'None' else 'solar lentigo' end as diagnosis,
        case d.n_chars % 4 when 0 then 'histopathology' when 1 then 'single image expert consensus' when 2 then 'serial imaging' else 'None' end as diagnosis_confirm_type,
        case when d.n_chars % 6 = 0 then 'None' when d.n_chars % 6 = 1 then '15' else cast(d.n_chars % 90 as string) end as age_approx,
        case d.lang when 'en' then 'female' when 'fr' then 'male' else 'None' end as sex, d.doc_id as line_no {_FROM}""",
    "raw_challenge_meta": f"""select {_REP} as image, case when d.n_chars % 7 = 0 then 'unknown' else cast(d.n_chars % 90 as string) end as age,
        case d.lang when 'en' then 'female' when 'fr' then 'male' else 'unknown' end as sex, d.doc_id as line_no from {{documents}} d""",
    # the file of truths is keyed by other text on some lines
    "raw_challenge_truth": f"""select case when d.n_chars % 13 = 0 then concat('X_', cast(d.doc_id as string)) else {_REP} end as image,
        case when l.toxic = 1 then '1.0' else '0.0' end as melanoma,
        case when l.quality = 0 and l.toxic = 0 then '1.0' else '0.0' end as keratosis, d.doc_id as line_no {_FROM}""",
    "raw_irma": f"""select {_REP} as image, case when coalesce(l.quality, 1) = 1 then '1' else '2' end as melanoma, d.doc_id as line_no {_FROM}""",
    "raw_ph2": f"""select {_REP} as image, case when d.n_chars % 3 = 0 then 'x' else '' end as histology,
        case when d.lang = 'en' then 'x' else '' end as common_nevus, case when d.lang = 'fr' then 'x' else '' end as atypical_nevus,
        case when l.toxic = 1 then 'x' else '' end as melanoma, d.doc_id as line_no {_FROM}""",
    "raw_dermofit": f"""select {_REP} as image, case d.n_chars % 4 when 0 then 'MEL' when 1 then 'SK' when 2 then 'AK' else 'BCC' end as diagnosis,
        d.doc_id as line_no {_FROM.split(' left')[0]}""",
    # pictures that exist are those with a label
    "v_listing": f"select {_IMG.format('l.doc_id')} as image from {{labels}} l",
    "v_blacklist": f"select {_IMG.format('l.doc_id')} as image from {{labels}} l where l.toxic = 1",
    "v_neardup": f"select {_IMG.format('l.doc_id')} as image, concat('dup_', cast(l.doc_id % 50 as string)) as case_id from {{labels}} l where l.quality = 1",
    "v_clinical": """select event_id, user_id, event_type, concat('{{"meta":{{"clinical":{{"diagnosis":"', event_type, '"',
        case when user_id % 3 = 0 then '' else concat(',"age_approx":', cast(user_id % 90 as string)) end,
        case when user_id % 4 = 0 then ',"sex":null' else ',"sex":"female"' end, '}}}}}}') as doc from {events}""",
    "v_truth": """select vec_id, case when label % 3 = 1 then 1 else 0 end as melanoma,
        case when label % 3 = 2 then 1 else 0 end as keratosis from {embeddings}""",
    "v_ckpt": """select cast(user_id as string) as model, event_id as checkpoint, row_number() over (partition by user_id order by ts, event_id) as seq,
        value as score from {events}""",
    "v_bigscore": """select l_orderkey as k1, l_linenumber as k2, l_extendedprice as score,
        case when l_returnflag = 'R' then 1 else 0 end as y, l_linestatus as stratum from {lineitem}""",
    "v_logits": (
        """select vec_id, label % 3 as truth, r as replica, cast(embedding[3*r] as double) as z0, cast(embedding[3*r+1] as double) as z1,
        cast(embedding[3*r+2] as double) as z2 from {embeddings} lateral view explode(sequence(0,20)) t as r""",
        """select vec_id, label % 3 as truth, r as replica, cast(embedding[3*r+1] as double) as z0, cast(embedding[3*r+2] as double) as z1,
        cast(embedding[3*r+3] as double) as z2 from {embeddings}, (select unnest(generate_series(0,20)) as r) t"""),
    "v_components": (
        """select vec_id, f as feature_set, k as replica, 1/(1+exp(-cast(embedding[2*(3*f+k-1)] as double))) as p_m,
        1/(1+exp(-cast(embedding[2*(3*f+k-1)+1] as double))) as p_k from {embeddings}
        lateral view explode(sequence(0,6)) a as f lateral view explode(sequence(1,3)) b as k""",
        """select vec_id, f as feature_set, k as replica, 1/(1+exp(-cast(embedding[2*(3*f+k-1)+1] as double))) as p_m,
        1/(1+exp(-cast(embedding[2*(3*f+k-1)+2] as double))) as p_k from {embeddings},
        (select unnest(generate_series(0,6)) as f) a, (select unnest(generate_series(1,3)) as k) b"""),
}
for _n, _at in (("v_pred1", 0), ("v_pred2", 2)):
    VIEWS[_n] = tuple(
        f"""select vec_id, 1/(1+exp(-cast(embedding[{_at + base}] as double))) as p_m,
        1/(1+exp(-cast(embedding[{_at + 1 + base}] as double))) as p_k from {{embeddings}}""" for base in (0, 1))

# Pictures: height 5..7, width 9 or 10, three channels, 8-bit samples from the embedding.
_SAMPLE = "floor(least(greatest((cast(embedding[{at}] as double) + 1) / 2, 0), 1) * 255)"
VIEWS["v_picture_size"] = f"""select vec_id, {_IMG.format('vec_id')} as image, cast(5 + vec_id % 3 as int) as height,
    cast(9 + vec_id % 2 as int) as width, 3 as channels, label % 3 as truth, embedding from {{embeddings}}"""


def duck_sample(y: str, x: str, c: str) -> str:
    """SQL for one 8-bit sample of a row of v_picture_size."""
    return "cast(" + _SAMPLE.format(at=f"((({y}) * width + ({x}) + 21 * ({c})) % 64) + 1") + " as double)"


def _parts(text: str) -> set[str]:
    return set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = VIEWS[name]
    text = text if isinstance(text, str) else text[0]
    return spark.sql(text, **{p: view(spark, sf_dir, p) for p in _parts(text)})


def duck(body: str, *names: str) -> str:
    """``body`` preceded by the views it uses."""
    ctes = []
    for n in names:
        text = VIEWS[n]
        text = text if isinstance(text, str) else text[1]
        ctes.append(f"{n} as ({text.format(**{p: p for p in _parts(text)})})")
    body = body.strip()
    if not ctes:
        return body
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picture table: image, height, width, channels, data (RGB bytes), truth."""
    source = view(spark, sf_dir, "v_picture_size")
    # sizes are a few bytes and pictures many: spread the rows before they are made
    source = source.repartition("image")
    return source.selectExpr(
        "image", "height", "width", "channels", "truth",
        """unhex(array_join(transform(sequence(0, height * width * 3 - 1),
             p -> lpad(hex(cast(floor(least(greatest((cast(embedding[(p div 3 + 21 * (p % 3)) % 64] as double) + 1) / 2, 0), 1) * 255) as int)), 2, '0')), '')) as data""")
