"""Files that the source queries read back: written by Spark tasks from the given tables."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.session import make_folder, scratch_path


def text_folder(df: DataFrame, tag: str, header: bool = True, sep: str = ",", blank: str = " ") -> str:
    """Delimited files with blanks around the separator's right side, as the sources have them."""
    path = scratch_path(df.sparkSession, tag)
    out = df.select([F.concat(F.lit(blank), F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in df.columns])
    out.write.option("header", header).option("sep", sep).option("quote", "").option("emptyValue", "") \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


#: Files of one folder, about, where there may be very many.
FOLDER_FILES = 1 << 15


def one_file_each(df: DataFrame, tag: str, below: int = 0) -> str:
    """One file per row (name, content) in the shared folder, written inside the tasks.

    A repeated task writes the same names and bytes again.  Names may lead into
    the folders 0 to ``below`` - 1.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, tag)
    for at in [folder, *(f"{folder}/{k}" for k in range(below))]:
        make_folder(spark, at)

    def write(batches):
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:")
                                              else "file://" + folder)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with system.open_output_stream(f"{root}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})
    df.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    return folder


def files_in_folders(df: DataFrame, tag: str, most: int = FOLDER_FILES) -> list[str]:
    """``one_file_each`` over as many folders as leave each about ``most`` files; rows of one name meet in one folder.

    A folder is written by one task: many writers of one folder wait for each other.
    """
    folders = max(-(-df.count() // most), 1)
    # a row without name gives the file that one_file_each gives it
    placed = df.select(F.coalesce("name", F.lit("None")).alias("name"), "content").withColumn("at", F.pmod(F.xxhash64("name"), F.lit(folders)))
    placed = placed.repartition(folders, "at").withColumn("name", F.concat(F.col("at").cast("string"), F.lit("/"), "name"))
    root = one_file_each(placed, tag, folders)
    return [f"{root}/{k}" for k in range(folders)]


def png(data: bytes, height: int, width: int, channels: int = 3) -> bytes:
    """Minimal 8-bit PNG (RGB or grey)."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * channels)
    raw = np.hstack([np.zeros((height, 1), np.uint8), rows]).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_files(pictures: DataFrame, tag: str = "pictures") -> str:
    def encode(batches):
        for pdf in batches:
            yield pd.DataFrame({"name": pdf["image"] + ".png", "content": [
                png(d, h, w, c) for d, h, w, c in zip(pdf["data"], pdf["height"], pdf["width"], pdf["channels"])]})
    return one_file_each(pictures.select("image", "height", "width", "channels", "data")
                         .mapInPandas(encode, "name string, content binary"), tag)
