"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text, so that other columns and their names never matter."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def id_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Key and UTF-8 bytes of the text (null: none)."""
    rows = id_text(docs, id_col, text_col)
    return rows.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))


def id_crc(id_col: str = "doc_id") -> Column:
    """crc32 of the key as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))


def by_rows(fn: Callable[[list, list], dict], schema: str) -> tuple[Callable, str]:
    """A mapInArrow function from fn(ids, texts) -> columns, with its schema as given to Spark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out
    return run, schema


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``most`` bytes of text at most (or one text)."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    block = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield a, b
    # what the slices took goes back to the system
    pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of many texts in a row: (number of each word's distinct form, distinct forms, words of each text).

    Words are what stands between blanks and \\t \\n \\v \\f \\r; ``lower`` lowers A-Z alone.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, many = parts.flatten(), pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(empty := np.flatnonzero(pc.equal(flat, "").to_numpy(zero_copy_only=False))):  # around leading and trailing blanks
        owner = np.searchsorted(np.cumsum(many), empty, side="right")
        many -= np.bincount(owner, minlength=len(many))
        flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, many


#: Bytes of one Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of the session at BATCH_BYTES, unless it keeps them smaller: rows of texts and sets are long."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    units = {"k": 10, "m": 20, "g": 30}
    now = spark.conf.get(key).lower().removesuffix("b")
    size = int(now[:-1]) << units[now[-1]] if now[-1:] in units else int(now)
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


#: Keys that a lookup spreads, at most: the most frequent ones that a sketch of SKETCH counters is sure of; and over how many parts.
HEAVY, SKETCH, PARTS = 1024, 16384, 256


def spread_lookup(rows: DataFrame, table: DataFrame, key: str, row_id: str) -> DataFrame:
    """Left join of many rows to a table of one row per key; rows of the most frequent keys are spread by ``row_id``.

    The table's rows of such keys are copied PARTS times: HEAVY * PARTS rows at most.
    """
    top = rows.agg(F.expr(f"approx_top_k(xxhash64({key}), {HEAVY}, {SKETCH})").alias("top")).select(F.explode("top.item").alias("_heavy"))
    # bounded: HEAVY numbers at most
    heavy = F.broadcast(top.withColumn("_spread", F.lit(PARTS)))
    many = rows.join(heavy, F.xxhash64(key) == F.col("_heavy"), "left").drop("_heavy")
    many = many.withColumn("_part", F.pmod(F.xxhash64(row_id), F.coalesce("_spread", F.lit(1))).cast("int")).drop("_spread")
    few = table.join(heavy, F.xxhash64(key) == F.col("_heavy"), "left").drop("_heavy")
    few = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_spread", F.lit(1)) - 1))).drop("_spread")
    return many.join(few, [key, "_part"], "left").drop("_part")


#: Bits of a filter of ids and bits set for each id: 8 MB whatever the number of ids.
FILTER_BITS, FILTER_HASHES = 1 << 26, 3


def _bit_places(ids: np.ndarray) -> np.ndarray:
    """FILTER_HASHES places for each id."""
    x = ids.astype(np.int64).view(np.uint64)[:, None] + np.arange(1, FILTER_HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def id_filter(ids: DataFrame):
    """A broadcast test ``ids -> may be among them`` for the ids of a one-column frame: never wrong about those that are.

    A Bloom filter of fixed size: with more ids it lets more others pass, so a join
    on the ids must follow.
    """
    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = _bit_places(pdf.iloc[:, 0].to_numpy()).ravel()
            yield pd.DataFrame({"word": at >> 5, "bit": np.left_shift(np.int64(1), at & 31)})
    words = ids.mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS >> 5, dtype=np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def may_hold(values: np.ndarray) -> np.ndarray:
        at = _bit_places(values)
        return ((shared.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1).all(axis=1)
    return may_hold
