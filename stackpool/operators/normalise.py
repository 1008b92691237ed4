"""Each raw source as one select onto the common metadata layout.

Every function takes the raw table (columns by position, see ``schemas``) with
``line_no`` and returns the common columns plus ``line_no``.  Filters that the
challenge modes apply are separate functions, so they push down on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackpool.operators.order import with_previous

MODES = ("ALL", "CHALLENGE", "DEPLOY")
COMMON = ("image", "case_id", "type", "age", "has_age", "sex", "has_sex",
          "melanoma", "keratosis", "schedule", "weight", "dataset")

# Text that marks a missing age or sex.
ARCHIVE_MISSING = "None"
CHALLENGE_MISSING = "unknown"
# Diagnoses and age left out of the challenge modes.
UNCERTAIN_DIAGNOSES = ("atypical melanocytic proliferation", "other", "None")
BIASED_AGE = "15"
# Label confidence by how the diagnosis was confirmed; anything else weighs 1.
CONFIRMATION_WEIGHTS = {"histopathology": 3, "single image expert consensus": 2}


def check_mode(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {' '.join(MODES)}, got {mode!r}")


def _known(field: str, missing: str) -> tuple[Column, Column]:
    """(value or '', flag) of a field whose absence is spelled ``missing``."""
    there = F.coalesce(F.col(field), F.lit("")) != missing
    return F.when(there, F.coalesce(F.col(field), F.lit(""))).otherwise(""), there.cast("int")


def _flagged(field: str, flag: str) -> tuple[Column, Column]:
    there = F.col(flag) == "1"
    return F.when(there, F.coalesce(F.col(field), F.lit(""))).otherwise(""), F.col(flag).try_cast("int")


def _number(text: str) -> Column:
    """Whole part of a numeric text such as '1.0'."""
    return F.col(text).cast("double").cast("int")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def _common(df: DataFrame, *, image="image", case_id="", type="d", age="", has_age=0, sex="", has_sex=0,
            melanoma=0, keratosis=0, schedule=1, weight=1, dataset: str) -> DataFrame:
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)
    return df.select(
        F.col(image).alias("image"), col(case_id).alias("case_id"), col(type).alias("type"),
        col(age).alias("age"), col(has_age).cast("int").alias("has_age"),
        col(sex).alias("sex"), col(has_sex).cast("int").alias("has_sex"),
        col(melanoma).cast("int").alias("melanoma"), col(keratosis).cast("int").alias("keratosis"),
        col(schedule).cast("double").alias("schedule"), col(weight).cast("double").alias("weight"),
        F.lit(dataset).alias("dataset"), "line_no")


def norm_atlas(df: DataFrame) -> DataFrame:
    age, has_age = _flagged("f6", "f7")
    sex, has_sex = _flagged("f8", "f9")
    return _common(df, image="f1", case_id=F.upper(F.coalesce("f2", F.lit(""))), type=F.lower(F.substring("f0", 1, 1)),
                   age=age, has_age=has_age, sex=sex, has_sex=has_sex,
                   melanoma=F.col("f4").try_cast("int"), keratosis=F.col("f5").try_cast("int"),
                   schedule=F.col("f10").try_cast("double"), weight=F.col("f11").try_cast("double"), dataset="atlas")


def filter_archive(df: DataFrame) -> DataFrame:
    """Drop uncertain diagnoses and the age with biased labels."""
    drop = F.col("diagnosis").isin(*UNCERTAIN_DIAGNOSES) | (F.col("age_approx") == BIASED_AGE)
    return df.filter(~F.coalesce(drop, F.lit(False)))


def norm_archive(df: DataFrame) -> DataFrame:
    age, has_age = _known("age_approx", ARCHIVE_MISSING)
    sex, has_sex = _known("sex", ARCHIVE_MISSING)
    weight = F.lit(1)
    for how, value in CONFIRMATION_WEIGHTS.items():
        weight = F.when(F.col("diagnosis_confirm_type") == how, value).otherwise(weight)
    return _common(df, age=age, has_age=has_age, sex=sex, has_sex=has_sex,
                   melanoma=_flag(F.col("diagnosis") == "melanoma"),
                   keratosis=_flag(F.col("diagnosis") == "seborrheic keratosis"),
                   schedule=2, weight=weight, dataset="isic")


def norm_challenge(df: DataFrame) -> DataFrame:
    age, has_age = _known("age", CHALLENGE_MISSING)
    sex, has_sex = _known("sex", CHALLENGE_MISSING)
    return _common(df, age=age, has_age=has_age, sex=sex, has_sex=has_sex,
                   melanoma=_number("melanoma"), keratosis=_number("keratosis"),
                   schedule=2, weight=5, dataset="challenge")


def filter_irma(df: DataFrame) -> DataFrame:
    return df.filter(F.col("melanoma") == "1")


def norm_irma(df: DataFrame) -> DataFrame:
    # every row counts as melanoma, also those that only the ALL mode keeps
    return _common(df, melanoma=1, dataset="irma")


def filter_ph2(df: DataFrame) -> DataFrame:
    """Drop atypical nevi."""
    return df.filter(F.length(F.coalesce("atypical_nevus", F.lit(""))) == 0)


def norm_ph2(df: DataFrame) -> DataFrame:
    def filled(c):
        return F.length(F.coalesce(c, F.lit(""))) > 0
    return _common(df, melanoma=_flag(filled("melanoma")),
                   weight=F.when(filled("histology"), 3).otherwise(1), dataset="ph2")


def norm_dermofit(df: DataFrame) -> DataFrame:
    return _common(df, melanoma=_flag(F.col("diagnosis") == "MEL"),
                   keratosis=_flag(F.col("diagnosis") == "SK"), dataset="dermofit")


def norm_test(df: DataFrame, idx: str = "line_no") -> DataFrame:
    """Unlabelled test metadata; a row that repeats the image before it is flagged, not dropped.

    ``idx`` is the dense position of the row in its file.
    """
    age, has_age = _known("age", CHALLENGE_MISSING)
    sex, has_sex = _known("sex", CHALLENGE_MISSING)
    df = with_previous(df, idx, ["image"])
    repeated = F.col("image") == F.coalesce("prev_image", F.lit(""))
    return df.select("image", F.lit("").alias("case_id"), F.lit("d").alias("type"), age.alias("age"),
                     has_age.alias("has_age"), sex.alias("sex"), has_sex.alias("has_sex"),
                     F.lit(0).alias("melanoma"), F.lit(0).alias("keratosis"), F.lit(0.0).alias("schedule"),
                     F.lit(0.0).alias("weight"), repeated.alias("duplicate"), F.col(idx).alias("line_no"))


def encode_record(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata as the numeric fields of a training record, plus the columns in ``keep``."""
    def number(c):
        return F.coalesce(F.col(c).try_cast("float"), F.lit(0.0).cast("float"))
    mel, ker = F.col("melanoma").cast("long"), F.col("keratosis").cast("long")
    return df.select(
        "image", F.coalesce("case_id", F.lit("")).alias("case_id"),
        F.when(mel == 1, 1).when(ker == 1, 2).otherwise(0).cast("long").alias("label"),
        mel.alias("melanoma"), ker.alias("keratosis"),
        F.when(F.col("type") == "d", 1.0).otherwise(0.0).cast("float").alias("type"),
        number("age").alias("age"), number("has_age").alias("has_age"),
        F.when(F.col("sex") == "female", 1.0).otherwise(0.0).cast("float").alias("sex"),
        number("has_sex").alias("has_sex"), number("schedule").alias("schedule"), number("weight").alias("weight"), *keep)


def null_to_none(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text output form: an absent value is the word None."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns})


def extract_clinical(df: DataFrame, column: str, fields: tuple[str, ...], at: str = "$.meta.clinical") -> DataFrame:
    """Fields of a JSON text column; any missing level gives null."""
    return df.withColumns({f: F.get_json_object(column, f"{at}.{f}") for f in fields})


def nonnull_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("images"), *[F.count(c).alias(c) for c in columns])


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (field, distinct value); an absent value is a value of its own, 'None'."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"),
                                         F.coalesce(F.col(c).cast("string"), F.lit("None")).alias("value"))
                                for c in columns]))
    return df.select(pairs.alias("p")).select("p.field", "p.value").distinct()
