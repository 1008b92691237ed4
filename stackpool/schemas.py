"""Table layouts.  '' marks an absent string; nothing is inferred from data."""

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Text columns by position; every field is text, as in the files.
METADATA = _strings("image", "case_id", "type", "age", "has_age", "sex", "has_sex",
                    "melanoma", "keratosis", "schedule", "weight", "dataset")
TEST_METADATA = T.StructType(METADATA.fields[:11])

ATLAS = _strings(*[f"f{i}" for i in range(12)])
ARCHIVE = _strings("image", "benign_malignant", "diagnosis", "diagnosis_confirm_type", "age_approx", "sex")
CHALLENGE_META = _strings("image", "age", "sex")
CHALLENGE_TRUTH = _strings("truth_image", "melanoma", "keratosis")
IRMA = _strings("image", "melanoma")
PH2 = _strings("image", "histology", "common_nevus", "atypical_nevus", "melanoma")
DERMOFIT = _strings("image", "diagnosis")
NEAR_DUPLICATES = _strings("image", "case_id")
TRUTH_TEXT = _strings("image", "melanoma", "keratosis")

PREDICTIONS = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("p_m", T.DoubleType()),
    T.StructField("p_k", T.DoubleType()),
])

CLINICAL = T.StructType([T.StructField("meta", T.StructType([T.StructField("clinical", T.StructType([
    T.StructField("benign_malignant", T.StringType()),
    T.StructField("diagnosis", T.StringType()),
    T.StructField("diagnosis_confirm_type", T.StringType()),
    T.StructField("age_approx", T.StringType()),
    T.StructField("sex", T.StringType()),
]))]))])
CLINICAL_FIELDS = ("benign_malignant", "diagnosis", "diagnosis_confirm_type", "age_approx", "sex")

# One training record: picture bytes plus encoded metadata.
RECORD = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("encoded", T.BinaryType()),
    T.StructField("format", T.StringType()),
    T.StructField("label", T.LongType()),
    T.StructField("melanoma", T.LongType()),
    T.StructField("keratosis", T.LongType()),
    T.StructField("height", T.LongType()),
    T.StructField("width", T.LongType()),
    T.StructField("type", T.FloatType()),
    T.StructField("age", T.FloatType()),
    T.StructField("has_age", T.FloatType()),
    T.StructField("sex", T.FloatType()),
    T.StructField("has_sex", T.FloatType()),
    T.StructField("schedule", T.FloatType()),
    T.StructField("weight", T.FloatType()),
])

# Value a reader gives for a field that a stored record lacks.
RECORD_DEFAULTS = {"format": "jpg", "image": "", "case_id": "", "label": 0, "melanoma": 0,
                   "keratosis": 0, "type": 0.0, "age": 0.0, "has_age": 0.0, "sex": 0.0,
                   "has_sex": 0.0, "schedule": 0.0, "weight": 0.0}

FEATURES = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
])

# Pictures: flat row-major pixels, channel last.
PIXELS = T.StructType([
    T.StructField("image", T.StringType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("pixels", T.ArrayType(T.DoubleType())),
])

SCORE_LOG = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("checkpoint", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("score", T.DoubleType()),
])

CLASS_NAMES = ("other", "melanoma", "keratosis")
SPLITS = ("train", "validation", "test")
