"""Meta-features of a stacked ensemble from component predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackpool.functions import scores as S
from stackpool.operators.joins import one_per_key

# Component sets in feature order, and replicas of each.
FEATURE_ORDER = ("rc25", "rc25_50_s", "rc25_max", "rc28", "rc28_50_s", "rc28_50avg_s", "rc30")
REPLICAS = (1, 2, 3)

# Which replica of each component set makes up one combination.
FEW_COMBINATIONS = [(1, 1, 1, 1, 1, 1, 1), (2, 2, 2, 2, 2, 2, 2), (3, 3, 3, 3, 3, 3, 3)]
ALL_COMBINATIONS = [
    (1, 1, 1, 1, 1, 1, 1), (1, 1, 1, 1, 1, 2, 1), (1, 1, 1, 3, 3, 3, 3), (1, 1, 2, 1, 2, 2, 2), (1, 1, 2, 1, 2, 3, 3),
    (1, 1, 2, 1, 3, 2, 2), (1, 1, 2, 2, 3, 2, 1), (1, 1, 2, 3, 1, 1, 1), (1, 1, 3, 2, 1, 3, 3), (1, 1, 3, 2, 2, 3, 3),
    (1, 1, 3, 2, 3, 2, 1), (1, 1, 3, 3, 1, 1, 1), (1, 2, 1, 2, 2, 1, 1), (1, 2, 1, 2, 2, 1, 2), (1, 2, 1, 2, 2, 3, 2),
    (1, 2, 1, 2, 3, 1, 2), (1, 2, 2, 1, 2, 1, 3), (1, 2, 2, 1, 2, 2, 3), (1, 2, 2, 1, 2, 3, 3), (1, 2, 2, 1, 3, 3, 1),
    (1, 2, 2, 2, 1, 1, 1), (1, 2, 2, 3, 2, 3, 3), (1, 2, 3, 1, 3, 1, 2), (1, 2, 3, 2, 2, 1, 2), (1, 3, 1, 2, 1, 1, 1),
    (1, 3, 1, 3, 1, 1, 1), (1, 3, 1, 3, 2, 2, 2), (1, 3, 2, 1, 2, 1, 3), (1, 3, 2, 1, 2, 2, 3), (1, 3, 2, 1, 3, 3, 3),
    (1, 3, 2, 2, 2, 2, 3), (1, 3, 2, 3, 1, 1, 2), (1, 3, 2, 3, 1, 2, 1), (1, 3, 2, 3, 1, 3, 2), (1, 3, 3, 1, 2, 1, 1),
    (1, 3, 3, 1, 3, 2, 3), (1, 3, 3, 2, 3, 1, 3), (1, 3, 3, 3, 1, 2, 1), (2, 1, 1, 2, 2, 3, 2), (2, 1, 1, 3, 2, 3, 2),
    (2, 1, 2, 2, 1, 3, 2), (2, 1, 2, 2, 3, 2, 3), (2, 1, 2, 3, 2, 2, 2), (2, 1, 2, 3, 3, 1, 1), (2, 1, 2, 3, 3, 3, 1),
    (2, 1, 3, 3, 3, 2, 2), (2, 1, 3, 3, 3, 3, 3), (2, 2, 1, 1, 1, 3, 3), (2, 2, 1, 2, 1, 3, 3), (2, 2, 2, 1, 3, 2, 2),
    (2, 2, 2, 2, 2, 1, 1), (2, 2, 2, 2, 2, 2, 2), (2, 2, 2, 2, 3, 3, 1), (2, 2, 3, 1, 2, 1, 3), (2, 2, 3, 1, 2, 2, 3),
    (2, 2, 3, 3, 1, 1, 2), (2, 2, 3, 3, 2, 2, 2), (2, 3, 1, 3, 1, 3, 1), (2, 3, 1, 3, 3, 2, 3), (2, 3, 2, 2, 3, 2, 2),
    (2, 3, 2, 3, 1, 3, 1), (2, 3, 3, 1, 1, 2, 1), (2, 3, 3, 1, 3, 2, 1), (2, 3, 3, 2, 2, 2, 1), (2, 3, 3, 2, 2, 3, 2),
    (2, 3, 3, 3, 1, 2, 3), (3, 1, 1, 1, 2, 1, 1), (3, 1, 1, 1, 2, 2, 3), (3, 1, 1, 2, 1, 2, 1), (3, 1, 1, 3, 2, 1, 3),
    (3, 1, 2, 1, 1, 1, 3), (3, 1, 2, 1, 2, 3, 1), (3, 1, 2, 1, 3, 2, 3), (3, 1, 2, 2, 3, 1, 2), (3, 1, 2, 3, 3, 1, 2),
    (3, 1, 3, 1, 1, 2, 2), (3, 1, 3, 2, 1, 1, 2), (3, 1, 3, 2, 3, 1, 3), (3, 1, 3, 2, 3, 3, 2), (3, 1, 3, 3, 1, 1, 2),
    (3, 2, 1, 1, 1, 1, 1), (3, 2, 1, 1, 2, 1, 2), (3, 2, 1, 2, 3, 1, 1), (3, 2, 1, 3, 2, 1, 2), (3, 2, 2, 1, 3, 1, 2),
    (3, 2, 2, 2, 1, 3, 2), (3, 2, 2, 3, 2, 1, 1), (3, 2, 3, 1, 1, 3, 1), (3, 2, 3, 1, 3, 1, 1), (3, 2, 3, 3, 1, 3, 1),
    (3, 3, 1, 1, 1, 3, 1), (3, 3, 1, 1, 2, 3, 1), (3, 3, 1, 2, 3, 2, 3), (3, 3, 1, 2, 3, 3, 3), (3, 3, 2, 1, 2, 1, 1),
    (3, 3, 2, 1, 2, 2, 2), (3, 3, 2, 2, 2, 1, 3), (3, 3, 3, 2, 1, 1, 2), (3, 3, 3, 2, 3, 3, 2), (3, 3, 3, 3, 3, 3, 3),
]
# Mode: (take log-odds in bits, use every combination).
MODES = {"LOGITS": (True, False), "ALL_LOGITS": (True, True), "PROBS": (False, False), "ALL_PROBS": (False, True)}


def combinations(mode: str) -> list[tuple[int, ...]]:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {' '.join(MODES)}, got {mode!r}")
    return ALL_COMBINATIONS if MODES[mode][1] else FEW_COMBINATIONS


def assemble(components: DataFrame, mode: str, key: str = "image", labels: DataFrame | None = None,
             chosen: list[tuple[int, ...]] | None = None) -> DataFrame:
    """One row of features per (image, combination).

    ``components`` has key, feature_set (0-based position in FEATURE_ORDER),
    replica (1-based), p_m, p_k.  All predictions of an image first meet in one
    row (a shuffle of sets x replicas rows per image); the combinations are
    then unfolded inside the task, so the large result is never shuffled.
    ``labels`` has key, melanoma, keratosis; without it every label is 0.
    """
    chosen = combinations(mode) if chosen is None else chosen
    as_bits = MODES[mode][0]
    value = S.bits_from_prob if as_bits else F.col
    slots = [(f, k) for f in range(len(FEATURE_ORDER)) for k in REPLICAS]

    def slot(f: int, k: int, value: str) -> Column:
        here = (F.col("feature_set") == f) & (F.col("replica") == k)
        return F.max(F.when(here, F.col(value)))

    valued = components.select(key, "feature_set", "replica", value("p_m").alias("_m"), value("p_k").alias("_k"))
    # plain double buffers, so the aggregate hashes instead of sorting
    per_image = valued.groupBy(key).agg(F.array(*[slot(f, k, v) for f, k in slots for v in ("_m", "_k")]).alias("_slots"))
    if labels is not None:
        # an image without a label fails the query
        known = one_per_key(labels, key, ["melanoma", "keratosis"]).select(key, S.label3("melanoma", "keratosis").alias("label"))
        per_image = per_image.join(known, key, "left").withColumn("label", F.when(
            F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for "), F.col(key).cast("string"))))
            .otherwise(F.col("label")))
    else:
        per_image = per_image.withColumn("label", F.lit(0))
    picks = F.array(*[F.lit([2 * (len(REPLICAS) * f + k - 1) + j for f, k in enumerate(combo) for j in (0, 1)])
                      for combo in chosen])
    unfolded = per_image.select(key, "label", "_slots", F.posexplode(picks).alias("comb_id", "_pick"))
    lost = F.raise_error(F.concat(F.lit("component prediction missing for "), F.col(key).cast("string")))
    features = F.transform("_pick", lambda i: F.coalesce(F.element_at(F.col("_slots"), i + 1), lost))
    return unfolded.select(key, "comb_id", "label", features.alias("features"))


def check_id_lists(components: DataFrame, key: str = "image") -> DataFrame:
    """Ids by which a component's list differs from that of the first component.

    One shuffle on the id; an id holds at most one entry per component.
    """
    tag = F.col("feature_set") * len(REPLICAS) + F.col("replica") - 1
    every = [F.lit(i) for i in range(len(FEATURE_ORDER) * len(REPLICAS))]
    seen = components.groupBy(key).agg(F.collect_set(tag.cast("int")).alias("_seen"))
    in_first = F.array_contains("_seen", 0)
    others = F.when(in_first, F.array_except(F.array(*every), F.col("_seen"))).otherwise(F.col("_seen"))
    return (seen.select(key, F.when(in_first, "missing").otherwise("extra").alias("problem"), F.explode(others).alias("_t"))
            .select(F.floor(F.col("_t") / len(REPLICAS)).cast("int").alias("feature_set"),
                    (F.col("_t") % len(REPLICAS) + 1).cast("int").alias("replica"), key, "problem"))
