"""Lines that many documents share, as keep bitmaps: hashes in ranges, sorted by document and position within.

Every line becomes a row of its hash, document and position.  Rows are dealt out by
ranges of the hash and sorted by (hash, document, position); a window then streams
over them, marks the first line of each key in each document, and the first one of
all.  Only the numbers of dropped lines go back to their documents, as run lengths.

A hash among the few that hold many rows is cut into parts by document, so that no
range holds it whole; the counts of its parts meet in a table of bounded size.  All
of it is column expressions: no Python runs in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackpool.session import materialise

#: Hashes that are cut into parts, at most: those among the most frequent that the sketch of SKETCH counters is sure of.
#: A hash that it misses holds about one row in SKETCH / 2 at most.
HEAVY, SKETCH = 1024, 16384
PARTS = 1024
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DOC = ["doc_id", "text_hash"]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text: rows that agree in both are one document's same lines."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text(text_col).alias("text"))
    return rows.withColumn("text_hash", F.xxhash64("text"))


def line_rows(docs: DataFrame, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line whose key has ``min_chars`` code points: doc_id, text_hash, place (from 0), h1, h2 (128 bits of the key)."""
    rows = _identified(docs, id_col, text_col)
    lines = rows.select(*_DOC, F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    keys = lines.withColumn("key", F.translate(F.trim("line", F.lit(_BLANK)), _UPPER, _UPPER.lower()))
    return keys.filter(F.char_length("key") >= min_chars).select(*_DOC, "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _parted(rows: DataFrame) -> DataFrame:
    """Adds ``part``: 0 but for heavy hashes, which are cut by document, and ``heavy``."""
    found = rows.agg(F.expr(f"approx_top_k(h1, {HEAVY}, {SKETCH})").alias("top")).select(F.explode("top.item").alias("h1"), F.lit(True).alias("heavy"))
    # bounded: HEAVY rows at most
    marked = rows.join(F.broadcast(found), "h1", "left").withColumn("heavy", F.coalesce("heavy", F.lit(False)))
    by_document = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_hash"))), F.lit(PARTS)).cast("int")
    return marked.withColumn("part", F.when(F.col("heavy"), by_document).otherwise(F.lit(0)))


def streamed(rows: DataFrame) -> DataFrame:
    """The rows of ``line_rows`` with ``first`` (no earlier line of all has the key) and ``n_docs`` (documents that have it)."""
    group = ["h1", "h2", "part"]
    ranged = _parted(rows).repartitionByRange(*group)
    in_order = Window.partitionBy(*group).orderBy("doc_id", "text_hash", "place")
    same = F.col("doc_id").eqNullSafe(F.lag("doc_id").over(in_order)) & (F.col("doc_id").isNotNull() | F.col("text_hash").eqNullSafe(F.lag("text_hash").over(in_order)))
    at = F.row_number().over(in_order)
    marked = ranged.withColumn("_new", ((at == 1) | ~same).cast("long")).withColumn("_first", (F.rank().over(in_order) == 1))
    # written once: the ranges would be made again for the counts of parts
    counted = materialise(marked.withColumn("_docs", F.sum("_new").over(Window.partitionBy(*group))).drop("_new"), "lines")
    # one row for each part of a heavy hash: HEAVY * PARTS at most, but for hashes that agree in 64 bits
    parts = counted.filter("heavy and _first").groupBy(*group).agg(F.min(F.struct("doc_id", "text_hash", "place")).alias("_least"), F.max("_docs").alias("_docs"))
    whole = parts.groupBy("h1", "h2").agg(F.sum("_docs").alias("_all"), F.min("_least").alias("_least"))
    out = counted.join(F.broadcast(whole), ["h1", "h2"], "left")
    first = F.col("_first") & (F.col("_least").isNull() | F.col("_least").eqNullSafe(F.struct("doc_id", "text_hash", "place")))
    return out.select(*_DOC, "place", "h1", "h2", first.alias("first"), F.coalesce("_all", "_docs").alias("n_docs"))


def _run_lengths(dropped: DataFrame) -> DataFrame:
    """(doc_id, text_hash) with the dropped places as [kept, dropped, kept, dropped, ...] and the line after the last run."""
    places = Window.partitionBy(*_DOC).orderBy("place")
    # rows that repeat share a rank, so they fall into one run
    runs = (dropped.withColumn("_run", F.col("place") - F.dense_rank().over(places)).groupBy(*_DOC, "_run")
            .agg(F.min("place").alias("start"), (F.max("place") + 1).alias("stop")))
    before = F.coalesce(F.lag("stop").over(Window.partitionBy(*_DOC).orderBy("start")), F.lit(0))
    gaps = runs.select(*_DOC, F.struct("start", (F.col("start") - before).alias("kept"), (F.col("stop") - F.col("start")).alias("gone")).alias("run"), "stop")
    listed = gaps.groupBy(*_DOC).agg(F.array_sort(F.collect_list("run")).alias("runs"), F.max("stop").alias("stop"))
    return listed.select(*_DOC, F.flatten(F.transform("runs", lambda r: F.array(r["kept"], r["gone"]))).alias("lengths"), "stop")


def keep_bitmaps(docs: DataFrame, min_chars: int = 1, min_docs: int = 10, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per (doc_id, text): doc_id, text_hash, n_lines, n_dropped, keep.

    Lines stand between line feeds; a null or empty text is one empty line.  A line's
    key is the line without blanks at both ends and with A-Z lowered.  Keys of at
    least ``min_chars`` code points found in at least ``min_docs`` documents lose all
    their lines, or with ``keep_first`` all but the first one by (doc_id, place).
    ``keep`` holds the lengths of runs of lines, kept and dropped in turn, kept first.

    Rows of one doc_id are one document, whatever their texts; rows without doc_id are
    one document for each text.  Rows that repeat both count once and share one bitmap.
    An empty table gives none.
    """
    drop = (F.col("n_docs") >= min_docs) if not keep_first else (F.col("n_docs") >= min_docs) & ~F.col("first")
    # written once: the sketch, the sample for the ranges and the shuffle all read these slim rows, not the texts
    hashed = materialise(line_rows(docs, min_chars, id_col, text_col), "hashed")
    lengths = _run_lengths(streamed(hashed).filter(drop).select(*_DOC, "place"))
    rows = _identified(docs, id_col, text_col)
    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int")
    known = rows.select(*_DOC, n_lines.alias("n_lines")).distinct()
    both = known.alias("a").join(lengths.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash")), "left")
    lengths_ = F.coalesce("lengths", F.array().cast("array<int>"))
    rest = F.col("n_lines") - F.coalesce("stop", F.lit(0))
    gone = F.aggregate(F.filter(lengths_, lambda x, i: i % 2 == 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select("a.doc_id", "a.text_hash", "n_lines", gone.alias("n_dropped"), F.concat(lengths_, F.array(rest)).alias("keep"))


def kept_text(text: Column, keep: Column) -> Column:
    """The text without the lines that a bitmap drops."""
    flags = F.flatten(F.transform(keep, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    # lines that go become null, which joining skips
    return F.array_join(F.zip_with(F.split(text, "\n", -1), flags, lambda line, stays: F.when(stays, line)), "\n")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept (the text that stays)."""
    rows, b = _identified(docs, id_col, text_col).alias("a"), bitmaps.alias("b")
    both = rows.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash")))
    return both.select("a.doc_id", F.col("n_lines").cast("long").alias("n_lines"), "n_dropped", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(kept_text(F.col("text"), F.col("keep"))).alias("kept"))


def digest(applied: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of the UTF-8 bytes that stay."""
    return applied.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
