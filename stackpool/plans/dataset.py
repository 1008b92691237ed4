"""Metadata plus pictures to a stored, split and sharded dataset."""

from __future__ import annotations

import re
import struct
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackpool.functions.draws import shuffle_key
from stackpool.operators import joins as J
from stackpool.operators import split as P
from stackpool.operators.normalise import encode_record

MODES = ("TRAIN", "TEST")
FILES_PER_BATCH = 64


def training_rows(meta: DataFrame, blacklist: DataFrame | None = None, seed: int = P.SEED,
                  per_shard: int = P.ROWS_PER_SHARD) -> DataFrame:
    """Split, shard and check training metadata.

    The check reads two columns of the already placed rows, and fails before
    the caller can write a dataset.  A case in two splits only gives a warning:
    pictures of a case that have different classes may be placed apart.
    """
    if blacklist is not None:
        meta = J.missing(meta, blacklist)
    rows = P.assign_shards(P.split_dataset(meta, seed), [shuffle_key(seed + 1, "image"), "line_no"], per_shard=per_shard)
    P.require_disjoint(rows)
    cases = P.contaminated(rows.filter("case_id is not null"), "case_id").take(5)
    if cases:
        warnings.warn(f"cases in more than one split, e.g. {[r['case_id'] for r in cases]}", stacklevel=2)
    return rows


def test_rows(meta: DataFrame, blacklist: DataFrame | None = None, per_shard: int = P.ROWS_PER_SHARD) -> DataFrame:
    """All rows to the test split in file order, neither split nor shuffled."""
    if blacklist is not None:
        meta = J.missing(meta, blacklist)
    return P.assign_shards(meta.withColumn("split", F.lit("test")), ["line_no"], per_shard=per_shard)


def convert(mode: str, meta: DataFrame, blacklist: DataFrame | None = None, **options) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"mode must be one of {' '.join(MODES)}, got {mode!r}")
    return (training_rows if mode == "TRAIN" else test_rows)(meta, blacklist, **options)


def test_class_counts(meta: DataFrame) -> DataFrame:
    """Class sizes of an unlabelled test set: everything counts as other."""
    n = F.count(F.lit(1))
    return meta.agg(n.alias("_n")).select(F.explode(F.create_map(
        F.lit("melanoma"), F.lit(0).cast("long"), F.lit("keratosis"), F.lit(0).cast("long"),
        F.lit("other"), F.col("_n"))).alias("stratum", "n"))


def records(rows: DataFrame, pictures: DataFrame) -> DataFrame:
    """Training records: encoded metadata joined to a table of picture bytes by image id.

    For picture files, :func:`records_from_files` moves no bytes.
    ``pictures`` has image, encoded, format, height, width.  An image without a
    picture fails the query.
    """
    meta = encode_record(rows, keep=("split", "shard", "pos"))
    joined = meta.join(pictures.select("image", "encoded", "format", "height", "width"), "image", "left")
    gone = F.raise_error(F.concat(F.lit("no picture for "), F.col("image")))
    return joined.withColumn("encoded", F.when(F.col("encoded").isNull(), gone).otherwise(F.col("encoded")))


def picture_size(data: bytes) -> tuple[int, int]:
    """(height, width) from the header of a JPEG or PNG file; pictures are not decoded."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height = struct.unpack(">II", data[16:24])
        return height, width
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        # start-of-frame markers carry the size
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return struct.unpack(">HH", data[at + 5:at + 9])
        at += 1 if marker == 0xFF else 2 + struct.unpack(">H", data[at + 2:at + 4])[0]
    raise ValueError("not a JPEG or PNG header")


def records_from_files(rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Training records whose picture bytes are read inside the task that writes their shard.

    ``listing`` has image and path.  Only ids and paths are joined and shuffled;
    the bytes, nearly all of the data, are never moved between executors.  Feed
    the result to ``write_shards(..., placed=True)``.
    """
    meta = encode_record(rows, keep=("split", "shard", "pos")).join(listing.select("image", "path"), "image", "left")
    gone = F.raise_error(F.concat(F.lit("no picture for "), F.col("image")))
    placed = (meta.withColumn("path", F.when(F.col("path").isNull(), gone).otherwise(F.col("path")))
              .repartition("split", "shard").sortWithinPartitions("split", "shard", "pos"))
    fields = [f for f in placed.schema if f.name != "path"]
    schema = T.StructType([*fields, T.StructField("encoded", T.BinaryType()), T.StructField("format", T.StringType()),
                           T.StructField("height", T.LongType()), T.StructField("width", T.LongType())])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for pdf in batches:
            for start in range(0, len(pdf), FILES_PER_BATCH):
                part = pdf.iloc[start:start + FILES_PER_BATCH]
                data = []
                for path in part["path"]:
                    # one store, two names: Hadoop says s3a, Arrow s3
                    system, name = fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
                    with system.open_input_stream(name) as f:
                        data.append(f.read())
                sizes = [picture_size(d) for d in data]
                yield part.drop(columns="path").assign(
                    encoded=data, format=[p.rsplit(".", 1)[-1].lower() for p in part["path"]],
                    height=[h for h, _ in sizes], width=[w for _, w in sizes])
    return placed.mapInPandas(read, schema)
