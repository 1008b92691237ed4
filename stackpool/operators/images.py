"""Pictures as rows: vectorised jobs over the picture table.

A picture row has image, height, width, channels and ``data`` (8-bit samples,
row-major, channel last, RGB), ``bgr`` (the same with channels reversed, as the
image source delivers them) or ``pixels`` (floats, RGB).  A job
is one ``mapInPandas`` over rows: no shuffle, bytes in, floats out, and a whole
named treatment runs in one crossing.  Draws depend on (seed, image, replica).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackpool.functions import pixels as X
from stackpool.functions.draws import draw, shuffle_key, uniforms

# Pictures handed back to Spark per Arrow batch.
BATCH = 32


class Row:
    """What a picture function may ask about the picture it works on."""

    def __init__(self, image: str, replica: int, seed: int, extra: dict):
        self.image, self.replica, self.seed, self.extra = image, replica, seed, extra

    def draws(self, *what) -> tuple[float, float, float, float]:
        return uniforms(self.seed, self.image, self.replica, *what)


PictureFn = Callable[[np.ndarray, Row], np.ndarray]


def from_image_source(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pictures, rejects) from Spark's image source; samples stay blue, green, red until a kernel reads them.

    Undecodable files and pictures without three channels are rejects.
    """
    flat = df.select(F.regexp_extract("image.origin", r"([^/]+)\.[^./]*$", 1).alias("image"),
                     F.col("image.height").alias("height"), F.col("image.width").alias("width"),
                     F.col("image.nChannels").alias("channels"), F.col("image.data").alias("bgr"))
    good = (F.col("height") > 0) & (F.col("channels") == 3)
    rejects = flat.filter(~good).select("image", F.when(F.col("height") <= 0, "undecodable")
                                        .otherwise("channels").alias("reason"))
    return flat.filter(good), rejects


def dimensions(df: DataFrame) -> DataFrame:
    """Picture sizes; the samples are never read."""
    return df.select("image", "height", "width")


def aspect_dimensions(df: DataFrame, side: int) -> DataFrame:
    """Size after an aspect-preserving resize, as column arithmetic in single precision."""
    h, w = F.col("height").cast("float"), F.col("width").cast("float")
    scale = (F.lit(side).cast("float") / F.least(h, w)).cast("float")
    return df.select("image", (h * scale).cast("int").alias("new_height"), (w * scale).cast("int").alias("new_width"))


def _read(row: dict, source: str, scale: float) -> np.ndarray:
    shape = (row["height"], row["width"], row["channels"])
    if source == "pixels":
        return np.asarray(row[source], np.float64).reshape(shape)
    img = np.frombuffer(row[source], np.uint8).reshape(shape) / scale
    return img[..., ::-1] if source == "bgr" else img


def _sample_column(df: DataFrame) -> str:
    return next(c for c in ("data", "bgr", "pixels") if c in df.columns)


def apply(df: DataFrame, fn: PictureFn, seed: int = 0, scale: float = 255.0, keep: list[str] = (),
          dtype: str = "float", copies: int | None = None) -> DataFrame:
    """Run ``fn`` on every picture; 8-bit samples are divided by ``scale`` first.

    ``keep`` columns pass through (``replica`` does whenever present).  With
    ``copies`` each picture is read once and given ``copies`` results, numbered
    by a new column ``replica``.  Arrow batches are bounded in bytes by Spark.
    """
    keep = [c for c in dict.fromkeys(["replica", *keep]) if c in df.columns]
    source = _sample_column(df)
    number = T.FloatType() if dtype == "float" else T.DoubleType()
    numbered = [T.StructField("replica", T.IntegerType())] if copies else []
    schema = T.StructType([df.schema["image"], *numbered, *[df.schema[c] for c in keep],
                           T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()),
                           T.StructField("channels", T.IntegerType()), T.StructField("pixels", T.ArrayType(number))])
    out_type = np.float32 if dtype == "float" else np.float64

    def results(pdf: pd.DataFrame) -> Iterator[tuple]:
        for r in pdf.to_dict("records"):
            img, kept = _read(r, source, scale), [r[c] for c in keep]
            for k in range(copies or 1):
                out = fn(img, Row(r["image"], k if copies else int(r.get("replica", 0)), seed, r))
                yield (r["image"], *([k] if copies else []), *kept, *out.shape, out.astype(out_type).ravel())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = results(pdf)
            while rows := list(islice(found, BATCH)):
                yield pd.DataFrame(rows, columns=schema.names)
    return df.select("image", *keep, "height", "width", "channels", source).mapInPandas(run, schema)


# --- single treatments --------------------------------------------------------

def resize(df: DataFrame, height: int, width: int, method: str = "bilinear", **kw) -> DataFrame:
    X.axis_taps(1, 1, method)
    return apply(df, lambda i, r: X.resize(i, height, width, method), **kw)


def central_fraction(df: DataFrame, fraction: float = X.CENTRAL_FRACTION, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.central_fraction(i, fraction), **kw)


def central_crop(df: DataFrame, height: int, width: int, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.central_crop([i], height, width)[0], **kw)


def offset_crop(df: DataFrame, height: int, width: int, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.offset_crop([i], height, width, r.draws("crop")[:2])[0], **kw)


def random_flip(df: DataFrame, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.flip(i) if r.draws("flip")[0] < 0.5 else i, **kw)


def flip(df: DataFrame, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.flip(i), **kw)


def crop_box(row: Row, shape, boxes=None, area=(0.05, 1.0), aspect=(0.75, 1.33)) -> tuple[int, int, int, int]:
    return X.sample_box(shape[0], shape[1], lambda a: row.draws("box", a), boxes, aspect, area)


def random_crop(df: DataFrame, boxes=None, area=(0.05, 1.0), aspect=(0.75, 1.33), **kw) -> DataFrame:
    """A random window of each picture; ``boxes`` is one list for all pictures or a column with a list for each."""
    if not isinstance(boxes, str):
        return apply(df, lambda i, r: X.crop(i, *crop_box(r, i.shape, boxes, area, aspect)), **kw)
    kw["keep"] = [*kw.get("keep", ()), boxes]
    return apply(df, lambda i, r: X.crop(i, *crop_box(r, i.shape, r.extra[boxes], area, aspect)), **kw)


#: Attempts at a window; the first few nearly always hold one, the others are only made where they do not.
ATTEMPTS, FIRST_ATTEMPTS, COVERED = 100, 4, 0.1


def crop_window(boxes: Column, seed: int = 0, replica: Column | None = None, area=(0.05, 1.0), aspect=(0.75, 1.33)) -> Column:
    """Struct (top, left, crop_height, crop_width): the window :func:`random_crop` cuts, as an expression.

    ``boxes`` is an array of (ymin, xmin, ymax, xmax) arrays in 0..1; null or
    empty stands for the whole picture.  The first attempt that fits the picture
    and holds enough of a box counts, else it is the whole picture.
    """
    height, width = F.col("height"), F.col("width")
    replica = F.lit(0) if replica is None else replica
    whole = F.array(F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)]))
    targets = F.when(F.size(boxes) > 0, boxes).otherwise(whole)

    def window(digest: Column) -> Column:
        u_area, u_aspect, u_top, u_left = (draw(digest, w) for w in range(4))
        size = (F.lit(area[0]) + F.lit(area[1] - area[0]) * u_area) * height * width
        ratio = F.lit(aspect[0]) + F.lit(aspect[1] - aspect[0]) * u_aspect
        h, w = F.floor(F.sqrt(size / ratio) + 0.5).cast("int"), F.floor(F.sqrt(size * ratio) + 0.5).cast("int")
        return F.struct((u_top * (height - h + 1)).cast("int").alias("top"), (u_left * (width - w + 1)).cast("int").alias("left"),
                        h.alias("crop_height"), w.alias("crop_width"))

    def covers(at: Column) -> Callable:
        def enough(box: Column) -> Column:
            ymin, xmin, ymax, xmax = (box[i] for i in range(4))
            tall = F.least(at["top"] + at["crop_height"], ymax * height) - F.greatest(at["top"], ymin * height)
            wide = F.least(at["left"] + at["crop_width"], xmax * width) - F.greatest(at["left"], xmin * width)
            all_of_it = (ymax - ymin) * height * (xmax - xmin) * width
            return (all_of_it > 0) & (F.greatest(tall, F.lit(0.0)) * F.greatest(wide, F.lit(0.0)) >= all_of_it * COVERED)
        return enough

    def counts(at: Column) -> Column:
        fits = at["crop_height"].between(1, height) & at["crop_width"].between(1, width)
        return fits & F.exists(targets, covers(at))

    def first(start: int, stop: int) -> Column:
        digests = F.transform(F.sequence(F.lit(start), F.lit(stop - 1)), lambda a: shuffle_key(seed, "image", replica, F.lit("box"), a))
        return F.get(F.filter(F.transform(digests, window), counts), F.lit(0))
    everything = F.struct(F.lit(0).alias("top"), F.lit(0).alias("left"), height.cast("int").alias("crop_height"), width.cast("int").alias("crop_width"))
    return F.coalesce(first(0, 1), first(1, FIRST_ATTEMPTS), first(FIRST_ATTEMPTS, ATTEMPTS), everything)


def crop_boxes(df: DataFrame, seed: int = 0, boxes=None, area=(0.05, 1.0), aspect=(0.75, 1.33)) -> DataFrame:
    """The windows :func:`random_crop` cuts, from picture sizes and ``boxes`` (a list for all pictures or a column) alone."""
    if isinstance(boxes, str):
        given = F.col(boxes).cast("array<array<double>>")
    else:
        given = F.array(*[F.array(*[F.lit(float(x)) for x in box]) for box in (() if boxes is None else boxes)]).cast("array<array<double>>")
    replica = F.col("replica").cast("int") if "replica" in df.columns else F.lit(0)
    found = crop_window(given, seed, replica, area, aspect)
    return df.select("image", replica.alias("replica"), found.alias("_window")).select("image", "replica", "_window.*")


def distort_color(df: DataFrame, fast: bool = True, **kw) -> DataFrame:
    return apply(df, lambda i, r: _color(i, r, fast), **kw)


def _color(img: np.ndarray, row: Row, fast: bool) -> np.ndarray:
    return X.distort_color(img, int(row.draws("order")[0] * 4), row.draws("color"), fast)


def normalise(df: DataFrame, mode: int, **kw) -> DataFrame:
    if mode not in (0, 1, 2):
        raise ValueError(f"normalisation must be 0, 1 or 2, got {mode!r}")
    return apply(df, lambda i, r: X.normalise(i, mode), **kw)


def subtract_means(df: DataFrame, means=X.CHANNEL_MEANS, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.subtract_means(i, means), scale=1.0, **kw)


def aspect_resize(df: DataFrame, side: int, **kw) -> DataFrame:
    return apply(df, lambda i, r: X.aspect_resize(i, side), **kw)


def draw_box(df: DataFrame, box=(0.0, 0.0, 1.0, 1.0), **kw) -> DataFrame:
    return apply(df, lambda i, r: X.draw_box(i, box), **kw)


# --- named treatments -----------------------------------------------------------

@dataclass(frozen=True)
class Options:
    """Settings of a named treatment; what a treatment does not know is refused."""
    fast: bool = True
    area: tuple[float, float] = (0.05, 1.0)
    boxes: tuple | None = None
    normalise: int = 0
    side_min: int = 256
    side_max: int = 512


def _augment(img: np.ndarray, row: Row, height: int, width: int, o: Options) -> np.ndarray:
    img = X.crop(img, *crop_box(row, img.shape, o.boxes, o.area))
    method = "bilinear" if o.fast else X.RESIZE_METHODS[int(row.draws("method")[0] * 4)]
    img = X.resize(img, height, width, method)
    if row.draws("flip")[0] < 0.5:
        img = X.flip(img)
    return X.normalise(_color(img, row, o.fast), o.normalise)


def _evaluate(img: np.ndarray, row: Row, height: int, width: int, o: Options) -> np.ndarray:
    return X.normalise(X.resize(X.central_fraction(img), height, width), o.normalise)


def _side_train(img: np.ndarray, row: Row, height: int, width: int, o: Options) -> np.ndarray:
    u_side, u_top, u_left, u_flip = row.draws("side")
    img = X.aspect_resize(img, o.side_min + int(u_side * (o.side_max - o.side_min + 1)))
    img = X.offset_crop([img], height, width, (u_top, u_left))[0]
    return X.subtract_means(X.flip(img) if u_flip < 0.5 else img)


def _side_eval(img: np.ndarray, row: Row, height: int, width: int, o: Options) -> np.ndarray:
    img = X.aspect_resize(img, o.side_min)
    return X.subtract_means(X.central_crop([img], height, width)[0])


# name: (training function, evaluation function, sample scale, options it takes)
TREATMENTS = {
    "dermatologic": (_augment, _evaluate, 255.0, {"fast", "area", "boxes", "normalise"}),
    "inception": (_augment, _evaluate, 255.0, {"fast", "boxes"}),
    "vgg": (_side_train, _side_eval, 1.0, {"side_min", "side_max"}),
}


def treat(df: DataFrame, name: str, height: int, width: int, training: bool, seed: int = 0,
          keep: list[str] = (), dtype: str = "float", **options) -> DataFrame:
    """Apply a named treatment to every picture (or every replica of it)."""
    step, scale = _treatment(name, height, width, training, options)
    return apply(df, step, seed, scale, keep, dtype)


def _treatment(name: str, height: int, width: int, training: bool, options: dict) -> tuple[PictureFn, float]:
    if name not in TREATMENTS:
        raise ValueError(f"preprocessing must be one of {' '.join(TREATMENTS)}, got {name!r}")
    train, evaluate, scale, known = TREATMENTS[name]
    if set(options) - known:
        raise ValueError(f"{name} does not take {sorted(set(options) - known)}")
    o = Options(**options)
    if o.normalise not in (0, 1, 2):
        raise ValueError(f"normalisation must be 0, 1 or 2, got {o.normalise!r}")
    step = train if training else evaluate
    return (lambda i, r: step(i, r, height, width, o)), scale


def replicas(df: DataFrame, name: str, height: int, width: int, count: int, seed: int = 0, keep: list[str] = (),
             dtype: str = "float", **options) -> DataFrame:
    """``count`` augmented copies per picture; a single copy takes the evaluation form.

    A picture crosses to Python once, whatever ``count`` is.
    """
    if count < 1:
        raise ValueError("at least one replica is needed")
    step, scale = _treatment(name, height, width, count > 1, options)
    return apply(df, step, seed, scale, keep, dtype, copies=count)


# Models by token, one per Python worker.
_models: dict[str, Callable] = {}


def score_replicas(df: DataFrame, make_predict_fn: Callable, n_out: int, name: str, height: int, width: int, count: int,
                   batch_size: int = 64, seed: int = 0, out: str = "logits", **options) -> DataFrame:
    """Augment and score in one crossing: picture bytes go in, ``n_out`` numbers per replica come out.

    The floats of a replica (thousands of times the size of its scores) never
    leave the task.  Result: image, replica, and the array ``out``.
    """
    if count < 1:
        raise ValueError("at least one replica is needed")
    step, scale = _treatment(name, height, width, count > 1, options)
    source, token = _sample_column(df), uuid.uuid4().hex

    def views(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                img = _read(r, source, scale)
                for k in range(count):
                    yield r["image"], k, step(img, Row(r["image"], k, seed, r)).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if token not in _models:
            _models[token] = make_predict_fn()
        found = views(batches)
        while part := list(islice(found, batch_size)):
            scores = np.asarray(_models[token](np.stack([p for _, _, p in part])), np.float64)
            yield pd.DataFrame({"image": [i for i, _, _ in part], "replica": [k for _, k, _ in part], out: list(scores)})
    schema = T.StructType([df.schema["image"], T.StructField("replica", T.IntegerType()),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select("image", "height", "width", "channels", source).mapInPandas(run, schema)


def score_models(df: DataFrame, models: dict[str, tuple[Callable, str, int, int, dict]], n_out: int, count: int,
                 batch_size: int = 64, seed: int = 0, out: str = "logits") -> DataFrame:
    """The same for many models at once: a picture is read and decoded once, whatever their number.

    ``models`` maps a name to (make_predict_fn, treatment, height, width, options).
    Models of equal treatment and size see the same replicas, drawn once.  Result:
    component (the name), image, replica, and the array ``out``.
    """
    if count < 1 or not models:
        raise ValueError("at least one replica and one model are needed")
    groups: dict[tuple, list[str]] = {}
    for name, (_, treatment, height, width, options) in models.items():
        groups.setdefault((treatment, height, width, tuple(sorted(options.items()))), []).append(name)
    steps = [(*_treatment(t, h, w, count > 1, dict(o)), members) for (t, h, w, o), members in groups.items()]
    source, token = _sample_column(df), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for name, (make, *_) in models.items():
            if token + name not in _models:
                _models[token + name] = make()
        waiting: list[list[tuple]] = [[] for _ in steps]

        def flush(g: int) -> Iterator[pd.DataFrame]:
            part, waiting[g] = waiting[g], []
            if part:
                views = np.stack([p for _, _, p in part])
                for name in steps[g][2]:
                    scores = np.asarray(_models[token + name](views), np.float64)
                    yield pd.DataFrame({"component": name, "image": [i for i, _, _ in part], "replica": [k for _, k, _ in part], out: list(scores)})

        for pdf in batches:
            for r in pdf.to_dict("records"):
                decoded: dict[float, np.ndarray] = {}
                for g, (step, scale, _) in enumerate(steps):
                    if scale not in decoded:
                        decoded[scale] = _read(r, source, scale)
                    for k in range(count):
                        waiting[g].append((r["image"], k, step(decoded[scale], Row(r["image"], k, seed, r)).astype(np.float32)))
                        if len(waiting[g]) == batch_size:
                            yield from flush(g)
        for g in range(len(steps)):
            yield from flush(g)
    schema = T.StructType([T.StructField("component", T.StringType()), df.schema["image"], T.StructField("replica", T.IntegerType()),
                           T.StructField(out, T.ArrayType(T.DoubleType()))])
    return df.select("image", "height", "width", "channels", source).mapInPandas(run, schema)


def score(df: DataFrame, make_predict_fn: Callable, n_out: int, batch_size: int, shape: tuple[int, int, int],
          out: str = "logits", keep: list[str] = ("replica",)) -> DataFrame:
    """Batch-score pictures of one shape with a user's model; pixels are dropped after scoring.

    ``make_predict_fn`` is called once per Python worker and returns a function
    from an array (batch, height, width, channels) to (batch, n_out).
    """
    predict = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                                input_tensor_shapes=[list(shape)])
    kept = [c for c in keep if c in df.columns]
    return df.select("image", *kept, predict(F.col("pixels").cast("array<float>")).cast("array<double>").alias(out))
