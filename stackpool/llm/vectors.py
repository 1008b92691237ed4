"""Reading embedding columns into matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Only key and vector; rows without a key, a vector or a component take no part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter("vec_id is not null and vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix of doubles) for each vector length in a batch of ``keyed`` rows."""
    lists = batch.column(1)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        own = lists if len(at) == len(lists) else lists.take(pa.array(at))
        yield batch.column(0).to_numpy(zero_copy_only=False)[at], own.flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(d))


def packed(matrix: np.ndarray) -> list[bytes]:
    """Rows of doubles as bytes."""
    return [row.tobytes() for row in np.ascontiguousarray(matrix, dtype="<f8")]


def unpacked(rows, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(-1, d)
