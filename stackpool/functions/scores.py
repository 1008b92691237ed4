"""Score arithmetic as Catalyst expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: probabilities are held this far away from 0 and 1 before taking odds.
SCEPTICISM = 0.00001
# Fixed value: decimals in the text form of a score.
SCORE_DECIMALS = 16

INFINITY = float("inf")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sigmoid(x) -> Column:
    """Logistic function, finite for scores of any size."""
    x = _c(x)
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def logit(p) -> Column:
    """Natural log-odds; 0 and 1 give minus and plus infinity."""
    p = _c(p)
    return (F.when(p <= 0, F.lit(-INFINITY)).when(p >= 1, F.lit(INFINITY))
            .otherwise(F.ln(p / (1.0 - p))))


def bits_from_prob(p, floor: float = SCEPTICISM) -> Column:
    """Log-odds in bits of a probability clipped to [floor, 1 - floor]."""
    p = F.least(F.greatest(_c(p), F.lit(floor)), F.lit(1.0 - floor))
    return F.log2(p / (1.0 - p))


def softmax_list(zs: list[Column]) -> list[Column]:
    """Softmax over separate class columns, shifted by the largest."""
    top = F.greatest(*zs) if len(zs) > 1 else zs[0]
    exps = [F.exp(z - top) for z in zs]
    total = exps[0]
    for e in exps[1:]:
        total = total + e
    return [e / total for e in exps]


def softmax(z, n_classes: int) -> Column:
    """Softmax over an array of ``n_classes`` logits."""
    z = _c(z)
    return F.array(*softmax_list([z[i] for i in range(n_classes)]))


def argmax(p) -> Column:
    """Index of the largest entry, the first one on ties."""
    p = _c(p)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(label, n_classes: int) -> Column:
    label = _c(label)
    return F.array(*[F.when(label == i, 1.0).otherwise(0.0) for i in range(n_classes)])


def binarize(label, positive: int) -> Column:
    return (_c(label) == positive).cast("int")


def label_offset(label, offset: int) -> Column:
    return _c(label) - F.lit(offset)


def label3(melanoma, keratosis) -> Column:
    """Three-way label; melanoma wins over keratosis."""
    return (F.when(_c(melanoma).cast("string") == "1", 1)
            .when(_c(keratosis).cast("string") == "1", 2).otherwise(0))


def append_scores(features, scores) -> Column:
    return F.concat(_c(features), _c(scores))


def format_score(x) -> Column:
    """Text with 16 decimals of the exact binary value.

    ``format_string`` pads the shortest decimal form instead, which differs in
    the last places.  The fraction is scaled to a whole number of 2^-60 (exact
    to 1e-18) and converted in decimal arithmetic.
    """
    x = _c(x)
    size = F.abs(x)
    whole = F.floor(size)
    ticks = ((size - whole) * F.lit(float(1 << 60))).cast("long").cast("decimal(19,0)")
    digits = F.bround(ticks * F.lit(10 ** SCORE_DECIMALS).cast("decimal(17,0)") / F.lit(1 << 60).cast("decimal(19,0)"))
    digits = digits.cast("long")
    carry = digits >= 10 ** SCORE_DECIMALS
    return F.concat(F.when(x < 0, "-").otherwise(""), (whole + carry.cast("int")).cast("string"), F.lit("."),
                    F.lpad(F.when(carry, 0).otherwise(digits).cast("string"), SCORE_DECIMALS, "0"))


def linear_score(features, weights: list[float], bias: float) -> Column:
    """w.x + b for a fixed weight vector held as literals, added in the order of the positions at any width."""
    w = F.lit([float(v) for v in weights])
    return F.aggregate(F.zip_with(_c(features), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.lit(float(bias))


def cross_entropy(z, label, n_classes: int, smoothing: float = 0.0) -> Column:
    """Softmax cross-entropy of one row against a smoothed one-hot target."""
    z, label = _c(z), _c(label)
    zs = [z[i] for i in range(n_classes)]
    top = F.greatest(*zs)
    total = sum((F.exp(v - top) for v in zs[1:]), F.exp(zs[0] - top))
    log_norm = top + F.ln(total)
    loss = F.lit(0.0)
    for i, v in enumerate(zs):
        target = F.when(label == i, 1.0).otherwise(0.0) * (1.0 - smoothing) + smoothing / n_classes
        loss = loss + target * (log_norm - v)
    return loss


def file_stem(path) -> Column:
    """Base name up to its first dot."""
    return F.substring_index(F.substring_index(_c(path), "/", -1), ".", 1)


def normal_filename(path) -> Column:
    """Base name in lower case with its extension replaced by .jpg."""
    base = F.lower(F.regexp_extract(_c(path), r"([^/]*)$", 1))
    return F.concat(F.regexp_replace(base, r"\.[^.]*$", ""), F.lit(".jpg"))


def register_sql(spark: SparkSession) -> None:
    """Make the helpers callable from SQL; the bodies are inlined by Catalyst."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION sigmoid(x DOUBLE) RETURNS DOUBLE
        RETURN CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION bits_from_prob(p DOUBLE) RETURNS DOUBLE
        RETURN log2(least(greatest(p, {SCEPTICISM}D), 1 - {SCEPTICISM}D)
                    / (1 - least(greatest(p, {SCEPTICISM}D), 1 - {SCEPTICISM}D)))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION softmax(z ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>
        RETURN transform(z, v -> exp(v - array_max(z))
               / aggregate(z, 0D, (s, u) -> s + exp(u - array_max(z))))""")
