"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows get the dense number they have in key order; the permutation of 0..n-1 is a
function of (seed, n) alone.  Place p of the permuted order is shard ``p mod s``,
slot ``p div s``: both are computable without any table, as is the way back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackpool.operators.order import global_index

ROUNDS = 6
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift steps), wrapping on purpose."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _half_bits(n: int) -> int:
    return max(1, ((n - 1).bit_length() + 1) // 2)


def _keys(seed: int) -> np.ndarray:
    return _mix((np.arange(1, ROUNDS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) ^ _U(seed % (1 << 64)))


def _rounds(x: np.ndarray, w: int, keys: np.ndarray, back: bool) -> np.ndarray:
    mask = _U((1 << w) - 1)
    left, right = x >> _U(w), x & mask
    for k in keys[::-1] if back else keys:
        if back:
            left, right = right ^ (_mix(left ^ k) & mask), left
        else:
            left, right = right, left ^ (_mix(right ^ k) & mask)
    return (left << _U(w)) | right


def permute(rows, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """Images of ``rows`` (each in 0..n-1) under the permutation of 0..n-1, or under its inverse.

    The Feistel network permutes 0..4^w-1, the least such range that holds n
    numbers.  A number that leaves 0..n-1 is walked on along its cycle until it
    is back; the expected number of steps is below four.
    """
    x = np.asarray(rows, dtype=_U).copy()
    w, keys = _half_bits(n), _keys(seed)
    todo = np.arange(len(x))
    while len(todo):
        x[todo] = _rounds(x[todo], w, keys, back)
        todo = todo[x[todo] >= _U(n)]
    return x.astype(np.int64)


def permuted(row_no: Column, n: int, seed: int = 0) -> Column:
    """The permutation as a column."""
    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))
    return place(row_no)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of ``shards`` shards whose row counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes + 1; 1 for a null text), text_crc32 (0 for
    a null text), shard, slot (gapless from 0 in a shard) and row_no, one row for
    each input row.  Row numbers follow doc_id (nulls first), then checksum, then
    size, so rows that repeat wholly are interchangeable.  An empty table gives none.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    numbered = global_index(rows, order, "row_no", "shards")
    last = numbered.agg(F.max("row_no").alias("last")).first()["last"]
    n = 1 if last is None else last + 1
    placed = numbered.withColumn("_place", permuted(F.col("row_no"), n, seed))
    return placed.select("doc_id", "size", "text_crc32", (F.col("_place") % shards).cast("int").alias("shard"),
                         F.floor(F.col("_place") / F.lit(shards)).cast("long").alias("slot"), "row_no")


def row_of(shard: int, slot: int, n: int, shards: int = 8, seed: int = 0) -> int:
    """Row number at a slot of a shard, without any table."""
    return int(permute([slot * shards + shard], n, seed, back=True)[0])
