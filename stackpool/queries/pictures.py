"""Picture operators; the SQL works sample by sample on the same pictures."""

import numpy as np
from pyspark.sql import functions as F

from stackpool.operators import images as I
from stackpool.plans import stack as K
from stackpool.queries import files
from stackpool.queries import registry
from stackpool.queries.registry import query
from stackpool.queries.scalars import P as PROBS
from stackpool.queries.views import duck, duck_sample, pictures, view
from stackpool.session import scratch_path
from stackpool.sources.images import scan_images

# Samples are compared at nine places: fewer can hit exact halves, as weights are short binary fractions.
PLACES = 9


def r6(x, name=None, places=PLACES):
    return registry.r6(x, name, places)


def d6(x, name=None, places=PLACES):
    return registry.d6(x, name, places)


C = "(select unnest([0,1,2]) as c) c"
GRID = "(select unnest(generate_series(0, {h})) as y) y, (select unnest(generate_series(0, {w})) as x) x, " + C
KW = {"dtype": "double"}


def long(df, *more, places=PLACES):
    """One row per sample: image, y, x, c, v."""
    at = F.col("pos")
    return (df.select("image", *more, "width", "channels", F.posexplode("pixels").alias("pos", "v"))
            .select("image", *more, F.floor(at / (F.col("width") * F.col("channels"))).cast("int").alias("y"),
                    (F.floor(at / F.col("channels")) % F.col("width")).cast("int").alias("x"),
                    (at % F.col("channels")).cast("int").alias("c"), r6("v", places=places)))


def sql(expr: str, h="height", w="width", more="", where="true", source="v_picture_size", grid=(13, 31),
        raw=False, places=PLACES) -> str:
    """Rows image, y, x, c, v for every target sample below (h, w)."""
    return (f"select image, {more} cast(y as int) as y, cast(x as int) as x, c, {expr + ' as v' if raw else d6(expr, 'v', places)} from {source}, "
            f"{GRID.format(h=grid[0], w=grid[1])} where y < {h} and x < {w} and {where}")


def u(key: str, word: int = 0) -> str:
    """SQL of one repeatable draw; ``key`` is SQL text appended to '0:image:replica:'."""
    return f"(('0x' || substr(md5('0:' || image || ':' || {key}), {8 * word + 1}, 8))::ubigint::double / 4294967296)"


def bilinear(oh: str, ow: str, y="y", x="x", h="height", w="width", top="0", left="0", scale="/255") -> str:
    """SQL of one bilinear target sample out of the window (top, left, h, w)."""
    sy, sx = f"(({y}) * (({h})::double / ({oh})))", f"(({x}) * (({w})::double / ({ow})))"
    y0, x0 = f"least(floor({sy})::int, ({h}) - 1)", f"least(floor({sx})::int, ({w}) - 1)"
    y1, x1 = f"least({y0} + 1, ({h}) - 1)", f"least({x0} + 1, ({w}) - 1)"

    def at(yy, xx):
        return duck_sample(f"({top}) + {yy}", f"({left}) + {xx}", "c") + scale
    ty, tx = f"({sy} - {y0})", f"({sx} - {x0})"
    return (f"((1-{ty})*((1-{tx})*{at(y0, x0)} + {tx}*{at(y0, x1)}) + {ty}*((1-{tx})*{at(y1, x0)} + {tx}*{at(y1, x1)}))")


PX = duck_sample("y", "x", "c")
V1 = "v_picture_size"


@query("scan_images", duck(sql(PX), V1))
def scan_images_(spark, sf):
    # PNG files written from the table, decoded by the image source
    pics, _ = scan_images(spark, files.png_files(pictures(spark, sf)))
    return long(I.apply(pics, lambda i, r: i, scale=1.0, **KW))


@query("img_dims", duck("select image, height, width from v_picture_size", V1))
def img_dims(spark, sf):
    return I.dimensions(pictures(spark, sf))


@query("img_resize", duck(sql(bilinear("12", "12"), "12", "12"), V1))
def img_resize(spark, sf):
    return long(I.resize(pictures(spark, sf), 12, 12, **KW))


@query("img_bilinear", duck(sql(bilinear("4", "6"), "4", "6"), V1))
def img_bilinear(spark, sf):
    return long(I.resize(pictures(spark, sf), 4, 6, "bilinear", **KW))


# no binary fractions here, so fewer places are safe and last-bit differences do not show
SIX = 6
_CELLS = "(select unnest(generate_series(0,6)) as i) i, (select unnest(generate_series(0,9)) as j) j"
_OY = "greatest(least(i+1, (y+1)*(height/3.0::double)) - greatest(i, y*(height/3.0::double)), 0)"
_OX = "greatest(least(j+1, (x+1)*(width/4.0::double)) - greatest(j, x*(width/4.0::double)), 0)"
_AREA = (f"select image, 'area' as method, cast(y as int) as y, cast(x as int) as x, c, {d6('sum(' + duck_sample('i', 'j', 'c') + '/255*' + _OY + '*' + _OX + ')/max(height/3.0::double*width/4.0::double)', 'v', SIX)} "
         f"from v_picture_size, {GRID.format(h=2, w=3)}, {_CELLS} where i < height and j < width group by image, y, x, c")


def _keys(d):
    return f"(case when {d} <= 1 then 1.25*{d}*{d}*{d} - 2.25*{d}*{d} + 1 when {d} < 2 then -0.75*{d}*{d}*{d} + 3.75*{d}*{d} - 6*{d} + 3 else 0 end)"


_SY, _SX = "(y*(height/7.0::double))", "(x*(width/11.0::double))"
_BICUBIC = (f"select image, 'bicubic' as method, cast(y as int) as y, cast(x as int) as x, c, {d6('sum(' + duck_sample(f'least(greatest(floor({_SY})::int + i, 0), height-1)', f'least(greatest(floor({_SX})::int + j, 0), width-1)', 'c') + '/255*' + _keys(f'abs({_SY} - floor({_SY}) - i)') + '*' + _keys(f'abs({_SX} - floor({_SX}) - j)') + ')', 'v', SIX)} "
            f"from v_picture_size, {GRID.format(h=6, w=10)}, (select unnest([-1,0,1,2]) as i) i, (select unnest([-1,0,1,2]) as j) j group by image, y, x, c")
_NEAREST = sql(duck_sample("floor(y*(height/4.0::double))::int", "floor(x*(width/6.0::double))::int", "c") + "/255", "4", "6", "'nearest' as method,", places=SIX)


@query("img_resize_methods", duck(f"{_NEAREST} union all {_AREA} union all {_BICUBIC}", V1))
def img_resize_methods(spark, sf):
    pics, out = pictures(spark, sf), None
    for method, h, w in (("nearest", 4, 6), ("area", 3, 4), ("bicubic", 7, 11)):
        part = long(I.resize(pics, h, w, method, **KW), places=SIX).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


_TOP, _LEFT = "trunc((height - height*0.5)/2)::int", "trunc((width - width*0.5)/2)::int"


@query("img_central_crop", duck(sql(duck_sample(f"y + {_TOP}", f"x + {_LEFT}", "c") + "/255", f"height - 2*{_TOP}", f"width - 2*{_LEFT}"), V1))
def img_central_crop(spark, sf):
    return long(I.central_fraction(pictures(spark, sf), 0.5, **KW))


def boxes_sql(replicas: int = 1, area=(0.05, 1.0)) -> str:
    """CTE b: crop window per (image, replica), the first of 100 attempts that counts."""
    key = "cast(r as varchar) || ':box:' || cast(a as varchar)"
    return f"""k0 as (select image, height, width, r, a, ({area[0]} + ({area[1]}::double - {area[0]}::double)*{u(key)})*height*width as size,
        0.75::double + (1.33::double - 0.75::double)*{u(key, 1)} as ratio, {u(key, 2)} as ut, {u(key, 3)} as ul
        from v_picture_size, (select unnest(generate_series(0,{replicas - 1})) as r) r, (select unnest(generate_series(0,99)) as a) a),
      k1 as (select *, cast(floor(sqrt(size/ratio)+0.5) as int) as ch, cast(floor(sqrt(size*ratio)+0.5) as int) as cw from k0),
      k2 as (select image, r, arg_min({{'t': trunc(ut*(height-ch+1))::int, 'l': trunc(ul*(width-cw+1))::int, 'h': ch, 'w': cw}}, a) as w from k1
        where ch between 1 and height and cw between 1 and width and ch*cw >= 0.1*height*width group by image, r),
      b as (select p.image, p.height, p.width, p.truth, p.embedding, r.r as replica, coalesce(w.t, 0) as top, coalesce(w.l, 0) as lft, coalesce(w.h, height) as ch, coalesce(w.w, width) as cw
        from v_picture_size p cross join (select unnest(generate_series(0,{replicas - 1})) as r) r left join k2 on k2.image = p.image and k2.r = r.r)"""


@query("img_random_crop", duck(f"with {boxes_sql()} {sql(duck_sample('top + y', 'lft + x', 'c') + '/255', 'ch', 'cw', source='b')}", V1))
def img_random_crop(spark, sf):
    return long(I.random_crop(pictures(spark, sf), **KW))


@query("img_crop_boxes", duck(f"with {boxes_sql(area=(0.2, 1.0))} select image, cast(top as int) as top, cast(lft as int) as left, ch as crop_height, cw as crop_width from b", V1))
def img_crop_boxes(spark, sf):
    return I.crop_boxes(pictures(spark, sf), area=(0.2, 1.0)).drop("replica")


_KEY = "'0:box:' || cast(a as varchar)"
_USER_BOXES = "[[0.0, 0.0, 0.25, 0.25], [0.5, 0.25 + (width % 3) / 4.0, 1.0, 1.0]]"


@query("img_crop_boxes_user", duck(f"""with k as (select image, height, width, a, cast({_USER_BOXES} as double[][]) as boxes,
        (0.05::double + (1.0::double - 0.05::double)*{u(_KEY)})*height*width as size, 0.75::double + (1.33::double - 0.75::double)*{u(_KEY, 1)} as ratio,
        {u(_KEY, 2)} as ut, {u(_KEY, 3)} as ul from v_picture_size, (select unnest(generate_series(0,99)) as a)),
      h as (select *, cast(floor(sqrt(size/ratio)+0.5) as int) as ch, cast(floor(sqrt(size*ratio)+0.5) as int) as cw from k),
      t as (select *, trunc(ut*(height-ch+1))::int as top, trunc(ul*(width-cw+1))::int as lft from h where ch between 1 and height and cw between 1 and width),
      e as (select *, unnest(boxes) as box from t),
      w as (select image, arg_min({{'t': top, 'l': lft, 'h': ch, 'w': cw}}, a) as w from e where greatest(least(top+ch, box[3]*height) - greatest(top, box[1]*height), 0)
        * greatest(least(lft+cw, box[4]*width) - greatest(lft, box[2]*width), 0) >= 0.1::double*((box[3]-box[1])*height*(box[4]-box[2])*width) group by image)
      select p.image, coalesce(n.w.t, 0) as top, coalesce(n.w.l, 0) as left, coalesce(n.w.h, height) as crop_height, coalesce(n.w.w, width) as crop_width
        from v_picture_size p left join w n on n.image = p.image""", V1))
def img_crop_boxes_user(spark, sf):
    # two boxes a picture, the second depends on its width
    boxes = F.expr("array(array(0.0D, 0.0D, 0.25D, 0.25D), array(0.5D, 0.25D + (width % 3) / 4.0D, 1.0D, 1.0D))")
    return I.crop_boxes(pictures(spark, sf).withColumn("boxes", boxes), boxes="boxes").drop("replica")


@query("img_flip", duck(sql(f"case when {u(chr(39) + '0:flip' + chr(39))} < 0.5 then {duck_sample('y', 'width-1-x', 'c')} else {PX} end/255"), V1))
def img_flip(spark, sf):
    return long(I.random_flip(pictures(spark, sf), **KW))


def color_sql(source: str, keys: str, replica: str) -> str:
    """Fast colour distortion of rows (keys, y, x, c, v) that carry image; result rows keys, y, x, c, v."""
    d, s = f"((2*{u(replica + ' || ' + chr(39) + ':color' + chr(39))}-1)*(32.0::double/255))", f"(0.5+{u(replica + ' || ' + chr(39) + ':color' + chr(39), 1)})"
    first = f"({u(replica + ' || ' + chr(39) + ':order' + chr(39))} < 0.25)"

    def saturated(v):
        return f"case when top <= 0 or top = low then top else top*(1 - least(greatest((top-low)/top*{s}, 0), 1)*(top-{v})/(top-low)) end"
    return f"""(select {keys}, y, x, c, least(greatest(case when bf then sat else sat + d end, 0), 1) as v from
      (select {keys}, y, x, c, bf, d, {saturated('v')} as sat from
       (select *, max(v) over (partition by {keys}, y, x) as top, min(v) over (partition by {keys}, y, x) as low from
        (select {keys}, y, x, c, {first} as bf, {d} as d, case when {first} then v + {d} else v end as v from {source}))))"""


@query("img_color", duck(f"with p as ({sql(PX + '/255', raw=True)}) select image, y, x, c, {d6('v', 'v')} from "
                         + color_sql("p", "image", "'0'"), V1))
def img_color(spark, sf):
    return long(I.distort_color(pictures(spark, sf), **KW))


@query("img_color_slow")
def img_color_slow(spark, sf):
    """All four distortions in one of four orders."""
    return long(I.distort_color(pictures(spark, sf), fast=False, **KW))


@query("img_norm_0", duck(sql(f"({PX}/255-0.5)*2"), V1))
def img_norm_0(spark, sf):
    return long(I.normalise(pictures(spark, sf), 0, **KW))


@query("img_norm_1", duck(sql(f"2*({PX}/255) - avg(2*({PX}/255)) over (partition by image, c)"), V1))
def img_norm_1(spark, sf):
    return long(I.normalise(pictures(spark, sf), 1, **KW))


@query("img_norm_2", duck(sql(f"({PX}/255 - avg({PX}/255) over (partition by image))/greatest(stddev_pop({PX}/255) over (partition by image), 1/sqrt(height*width*3))*0.4"), V1))
def img_norm_2(spark, sf):
    return long(I.normalise(pictures(spark, sf), 2, **KW))


_MEANS = "case c when 0 then 123.68 when 1 then 116.78 else 103.94 end"


@query("img_mean_subtract", duck(sql(f"{PX} - {_MEANS}"), V1))
def img_mean_subtract(spark, sf):
    return long(I.subtract_means(pictures(spark, sf), **KW))


def aspect(side: str, of: str) -> str:
    return f"trunc(cast({of} as float) * (cast({side} as float) / cast(least(height, width) as float)))::int"


@query("img_aspect_dims", f"""with s as (select p_partkey as image, cast(100 + p_size*41 as int) as height, cast(trunc(100 + p_retailprice) as int) as width from part)
    select image, {aspect('256', 'height')} as new_height, {aspect('256', 'width')} as new_width from s""")
def img_aspect_dims(spark, sf):
    sizes = view(spark, sf, "part").select(F.col("p_partkey").alias("image"), (100 + F.col("p_size") * 41).cast("int").alias("height"),
                                           (100 + F.col("p_retailprice")).cast("int").alias("width"))
    return I.aspect_dimensions(sizes, 256)


@query("img_aspect_resize", duck(sql(bilinear(aspect("8", "height"), aspect("8", "width")), aspect("8", "height"), aspect("8", "width")), V1))
def img_aspect_resize(spark, sf):
    return long(I.aspect_resize(pictures(spark, sf), 8, **KW))


_CROP = {"central": (f"y + (height-4)//2", f"x + (width-6)//2"),
         "offset": (f"y + trunc({u(chr(39) + '0:crop' + chr(39))}*(height-3))::int", f"x + trunc({u(chr(39) + '0:crop' + chr(39), 1)}*(width-5))::int")}


@query("img_crop", duck(" union all ".join(sql(duck_sample(a, b, "c") + "/255", "4", "6", f"'{k}' as kind,") for k, (a, b) in _CROP.items()), V1))
def img_crop(spark, sf):
    pics = pictures(spark, sf)
    return (long(I.central_crop(pics, 4, 6, **KW)).withColumn("kind", F.lit("central"))
            .unionByName(long(I.offset_crop(pics, 4, 6, **KW)).withColumn("kind", F.lit("offset"))))


_BT, _BB, _BL, _BR = "trunc(0.2*(height-1))::int", "trunc(0.8*(height-1))::int", "trunc(0.1*(width-1))::int", "trunc(0.9*(width-1))::int"


@query("img_draw_box", duck(sql(f"""case when (y in ({_BT}, {_BB}) and x between {_BL} and {_BR}) or (x in ({_BL}, {_BR}) and y between {_BT} and {_BB})
    then case when c < 2 then 1 else 0 end else {PX}/255 end"""), V1))
def img_draw_box(spark, sf):
    return long(I.draw_box(pictures(spark, sf), (0.2, 0.1, 0.8, 0.9), **KW))


# --- named treatments ---------------------------------------------------------------

_K = chr(39) + "0:side" + chr(39)
_SIDE = f"(12 + trunc({u(_K)}*9)::int)"
_OH, _OW = aspect(_SIDE, "height"), aspect(_SIDE, "width")
_VY, _VX = f"(y + trunc({u(_K, 1)}*(oh-7))::int)", f"(case when {u(_K, 3)} < 0.5 then 7 - x else x end + trunc({u(_K, 2)}*(ow-7))::int)"


@query("img_vgg_train", duck(f"with s as (select *, {_OH} as oh, {_OW} as ow from v_picture_size) " +
                             sql(f"{bilinear('oh', 'ow', _VY, _VX, scale='')} - {_MEANS}", "8", "8", source="s"), V1))
def img_vgg_train(spark, sf):
    return long(I.treat(pictures(spark, sf), "vgg", 8, 8, True, side_min=12, side_max=20, **KW))


_VE = aspect("8", "height"), aspect("8", "width")


@query("img_treatments_eval", duck(" union all ".join(
    [sql(f"({bilinear('6', '6')}-0.5)*2", "6", "6", f"'{n}' as name,") for n in ("dermatologic", "inception")] +
    [sql(f"{bilinear('oh', 'ow', 'y + (oh-6)//2', 'x + (ow-6)//2', scale='')} - {_MEANS}", "6", "6", "'vgg' as name,",
         source=f"(select *, {_VE[0]} as oh, {_VE[1]} as ow from v_picture_size)")]), V1))
def img_treatments_eval(spark, sf):
    pics, out = pictures(spark, sf), None
    for name, options in (("dermatologic", {}), ("inception", {}), ("vgg", {"side_min": 8})):
        part = long(I.treat(pics, name, 6, 6, False, **options, **KW)).withColumn("name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


REPLICAS = 3
_XF = f"case when {u('cast(replica as varchar) || ' + chr(39) + ':flip' + chr(39))} < 0.5 then 4 - x else x end"
AUGMENTED = (f"{boxes_sql(REPLICAS)}, a0 as (select image, replica, cast(y as int) as y, cast(x as int) as x, c, "
             f"{bilinear('5', '5', 'y', _XF, 'ch', 'cw', 'top', 'lft')} as v from b, {GRID.format(h=4, w=4)}), "
             f"aug as (select image, replica, y, x, c, (v-0.5)*2 as v from {color_sql('a0', 'image, replica', 'cast(replica as varchar)')})")


@query("img_replicas", duck(f"with {AUGMENTED} select image, cast(replica as int) as replica, y, x, c, {d6('v', 'v')} from aug", V1))
def img_replicas(spark, sf):
    return long(I.replicas(pictures(spark, sf), "dermatologic", 5, 5, REPLICAS, **KW), "replica")


# --- scoring ---------------------------------------------------------------------------

# a small fixed head over the channel means
HEAD = [[0.5, -1.0, 0.75], [-0.25, 1.5, -0.5], [1.25, 0.25, -1.0]]
BIAS = [0.125, -0.25, 0.0]


def head(with_features: bool = False, scale: float = 1.0, shift: float = 0.0):
    """make_predict_fn of the fixed head; optionally appends the channel means as features.

    ``scale`` times the weights and ``shift`` times the class number make heads that differ.
    """
    def make():
        w, b = scale * np.array(HEAD), np.array(BIAS) + shift * np.arange(3)

        def predict(batch):
            means = np.asarray(batch, np.float64).mean(axis=(1, 2))
            logits = means @ w + b
            return (np.hstack([logits, means]) if with_features else logits).astype(np.float32)
        return predict
    return make


def _logit_sql(source: str, keys: str) -> str:
    m = "select {k}, avg(case when c=0 then v end) as m0, avg(case when c=1 then v end) as m1, avg(case when c=2 then v end) as m2 from {s} group by {k}".format(k=keys, s=source)
    z = ", ".join(" + ".join(f"m{i}*({HEAD[i][j]})" for i in range(3)) + f" + ({BIAS[j]}) as z{j}" for j in range(3))
    return f"select {keys}, {z} from ({m})"


def r4(expr, name):
    return (F.round(expr.cast("double"), 4) + F.lit(0.0)).alias(name)


def d4(x, name):
    return f"round(cast({x} as double),4)+0.0 as {name}"


@query("score_images", duck(f"with e as ({sql('(' + bilinear('6', '6') + '-0.5)*2', '6', '6', raw=True)}) select image, "
                            f"{', '.join(d4(f'z{j}', f'z{j}') for j in range(3))} from ({_logit_sql('e', 'image')})", V1))
def score_images(spark, sf):
    # single precision inside, so four places are compared
    views = I.treat(pictures(spark, sf), "dermatologic", 6, 6, False)
    return I.score(views, head(), 3, 64, (6, 6, 3)).select("image", *[r4(F.col("logits")[j], f"z{j}") for j in range(3)])


_POOLED = f"with {AUGMENTED}, z as ({_logit_sql('aug', 'image, replica')})"


@query("component_scores", duck(f"""{_POOLED} select image, {d4(f'avg({PROBS[1]})', 'p_m')}, {d4(f'avg({PROBS[2]})', 'p_k')} from z group by image""", V1))
def component_scores(spark, sf):
    pooled = K.score_component(pictures(spark, sf), head(), "dermatologic", 5, 5, REPLICAS, "avg")
    return K.component_projection(pooled).select("image", r4(F.col("p_m"), "p_m"), r4(F.col("p_k"), "p_k"))


@query("component_features", duck(f"""with {AUGMENTED}, m as (select image, replica, avg(case when c=0 then v end) as m0, avg(case when c=1 then v end) as m1,
    avg(case when c=2 then v end) as m2 from aug group by image, replica), z as ({_logit_sql('aug', 'image, replica')})
    select m.image, {', '.join(d4(f'avg(m{j})', f'f{j}') for j in range(3))}, {', '.join(d4(f'avg(z{j})', f'f{j + 3}') for j in range(3))} from m join z using (image, replica) group by m.image""", V1))
def component_features(spark, sf):
    out = K.feature_component(pictures(spark, sf), head(True), 3, "dermatologic", 5, 5, REPLICAS)
    return out.select("image", *[r4(F.col("features")[j], f"f{j}") for j in range(6)])


# seven models by three folds
_SCALE, _SHIFT = "(1 + f * 0.125)", "(k * 0.0625)"


@query("component_predictions", duck(f"""{_POOLED}, w as (select image, 'model' || f || '.' || k as component, {', '.join(
    f"(z{j} - ({BIAS[j]})) * {_SCALE} + ({BIAS[j]}) + {j} * {_SHIFT} as z{j}" for j in range(3))}
    from z, (select unnest(range(7)) as f), (select unnest(range(1, 4)) as k))
    select component, image, {d4(f'avg({PROBS[1]})', 'p_m')}, {d4(f'avg({PROBS[2]})', 'p_k')} from w group by component, image""", V1))
def component_predictions(spark, sf):
    """All 21 predictions of every picture from one reading of it."""
    parts = [K.Component(f"model{f}.{k}", head(False, 1 + f * 0.125, k * 0.0625), "dermatologic", 5, 5) for f in range(7) for k in (1, 2, 3)]
    found = K.predict_components(pictures(spark, sf), parts, scratch_path(spark, "predictions"), REPLICAS, "avg")
    return found.select("component", "image", r4(F.col("p_m"), "p_m"), r4(F.col("p_k"), "p_k"))
