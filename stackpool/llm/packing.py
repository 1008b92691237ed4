"""Best-fit decreasing packing of token pieces into sequences of fixed length.

A piece is no longer than a sequence, so the table of all lengths has at most
``capacity`` rows.  The driver packs from that table: for each length, from the
longest down, a segment tree over remaining capacities finds the tightest open
sequences in logarithmic time, and pieces of equal length that meet sequences of
equal room are placed in one step.  The plan says which run of pieces of a length
goes where; it has at most about capacity^2 / 2 rows at any input size.
Pieces find their own place by their number among the pieces of their length.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackpool.llm.common import id_text, slices, task_number
from stackpool.session import materialise

END_ID = 0
#: Words kept between documents (twice over); a forgotten or longer word is only encoded again.
CACHE_WORDS = 1 << 17
CACHED_WORD = 64
_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, nth long"


class RoomTree:
    """Segment tree over 0..capacity: which amounts of room some open sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.has = [False] * (2 * self.leaves)

    def set(self, room: int, present: bool) -> None:
        i = room + self.leaves
        self.has[i] = present
        while i > 1:
            i >>= 1
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that some open sequence has."""
        i = length + self.leaves
        while not self.has[i]:
            while i & 1:  # no right neighbour under this parent
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.has[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts`` pieces of each length.

    Returns (length, first, pieces, sequence, each, offset): the pieces numbered
    first..first+pieces-1 of that length go to sequences from ``sequence`` on,
    ``each`` to a sequence, the first at ``offset`` in it.
    """
    tree, rooms, opened, plan = RoomTree(capacity), {}, 0, []

    def add(room: int, first: int, many: int) -> None:
        if room and many:
            if not rooms.setdefault(room, []):
                tree.set(room, True)
            rooms[room].append((first, many))

    for length in sorted(counts, reverse=True):
        left, done = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                many = -(-left // (capacity // length))
                add(capacity, opened, many)
                opened += many
                continue
            first, many = rooms[room].pop()
            if not rooms[room]:
                tree.set(room, False)
            # a sequence stays the tightest until it has no room for this length
            each = min(room // length, left)
            full = min(many, left // each)
            plan.append((length, done, full * each, first, each, capacity - room))
            add(room - each * length, first, full)
            add(room, first + full, many - full)
            left, done = left - full * each, done + full * each
    return plan


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds:
    """Ids of many texts by a tokenizer that drops white space, a distinct word at a time.

    The ids of a text are those of its parts between ASCII white space, one after
    the other.  A part that is lower-case Latin letters and then ASCII punctuation
    is two pre-tokens that the normaliser leaves alone, so the model takes them
    directly; every other part goes through the whole tokenizer.
    """

    # no apostrophe (contractions) and no '<' (special tokens) among the punctuation
    PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]*)([!-&(-/:;=>?@\[-`{-~]*)")

    def __init__(self, model_text: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(model_text)
        # words of late, and those before them
        self.kept: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def pretoken(self, letters: str) -> bytes:
        found = self.kept.get(letters)
        if found is None and (found := self.older.get(letters)) is not None:
            self.kept[letters] = found
        if found is None:
            # byte-level alphabet: bytes of printable Latin-1 characters stand for themselves, the others come after 255
            seen = letters if letters.isascii() else "".join(BYTE_LETTERS[b] for b in letters.encode())
            found = _packed([t.id for t in self.tokenizer.model.tokenize(seen)])
            if len(letters) <= CACHED_WORD:
                self.kept[letters] = found
        return found

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word as bytes of unsigned 32-bit numbers."""
        if len(self.kept) > CACHE_WORDS:
            self.kept, self.older = {"": b""}, self.kept
        out: list = [None] * len(words)
        odd = []
        for i, word in enumerate(words):
            m = self.PLAIN.fullmatch(word if "<|" in word else word.lower())
            if m:
                letters, marks = m.groups()
                out[i] = self.pretoken(letters) + self.pretoken(marks) if marks else self.pretoken(letters)
            else:
                odd.append(i)
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([words[i] for i in odd], add_special_tokens=False)):
            out[i] = _packed(e.ids)
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row as unsigned 32-bit numbers, each text's ids then END_ID; where each text ends)."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        own = self.words(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own)) // 4
        flat = np.frombuffer(b"".join(own), dtype="<u4")
        starts = np.cumsum(sizes) - sizes
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        many = sizes[which]
        ends = np.cumsum(many)
        ids = flat[np.repeat(starts[which] - ends + many, many) + np.arange(int(many.sum()))] if len(which) else flat
        last = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        doc_ends = np.concatenate([[0], ends])[last]
        return np.insert(ids, doc_ends, END_ID), doc_ends + np.arange(1, len(doc_ends) + 1)


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 characters for themselves, other bytes from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of all documents: ids of the text, then END_ID, cut every ``capacity`` tokens.

    ``part`` is the task that made a row and ``nth`` the number of earlier pieces
    of its length in that task; both hold only for one written evaluation.
    A null or empty text is the one token END_ID.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = word_coder(model.value), task_number()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids, ends = coder.texts(batch.column(1)[a:b])
                raw = memoryview(ids).cast("B")
                cols: tuple[list, ...] = ([], [], [], [], [], [], [])
                begin = 0
                for doc, end in zip(batch.column(0)[a:b].to_pylist(), ends.tolist()):
                    for k, at in enumerate(range(begin, end, capacity)):
                        n = min(capacity, end - at)
                        for c, v in zip(cols, (doc, k, at - begin, n, zlib.crc32(raw[4 * at:4 * (at + n)]), part, int(seen[n]))):
                            c.append(v)
                        seen[n] += 1
                    begin = end
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return rows.mapInArrow(run, _PIECES)


_coders: dict[int, WordIds] = {}


def word_coder(model_text: str) -> WordIds:
    """One coder a worker process, so that its words serve later tasks too."""
    key = hash(model_text)
    if key not in _coders:
        _coders.clear()
        _coders[key] = WordIds(model_text)
    return _coders[key]


def place(numbered: DataFrame, plan: list[tuple], length: str = "length", number: str = "_number") -> DataFrame:
    """Add sequence_id and offset to pieces that carry their number among those of their length."""
    held = numbered.sparkSession.sparkContext.broadcast(np.array(sorted(plan), dtype=np.int64).reshape(-1, 6))

    @F.pandas_udf("sequence_id long, offset long")
    def find(lengths: pd.Series, numbers: pd.Series) -> pd.DataFrame:
        rows = held.value
        span = int(rows[:, 2].max()) + int(rows[:, 1].max()) + 1
        size, no = lengths.to_numpy(dtype=np.int64), numbers.to_numpy(dtype=np.int64)
        # the last planned run of the length that starts at or before the piece
        if span * (int(rows[:, 0].max()) + 1) < 1 << 62:
            at = np.searchsorted(rows[:, 0] * span + rows[:, 1], size * span + no, side="right") - 1
        else:
            at = np.empty(len(no), dtype=np.int64)
            for s in np.unique(size):
                lo, hi = np.searchsorted(rows[:, 0], [s, s + 1])
                at[size == s] = lo + np.searchsorted(rows[lo:hi, 1], no[size == s], side="right") - 1
        _, first, _, sequence, each, offset = rows[at].T
        return pd.DataFrame({"sequence_id": sequence + (no - first) // each, "offset": offset + (no - first) % each * size})

    return numbered.withColumn("_at", find(F.col(length), F.col(number)))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into as few sequences of ``capacity`` tokens as best-fit decreasing needs.

    Returns one row per piece: doc_id, piece (from 0), start (ids of its document
    before it), length, ids_crc32, sequence_id (gapless from 0) and offset.  Every
    input row, also a repeated or null one, has at least one piece; an empty
    table has none.
    """
    stored = materialise(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pieces")
    sizes = stored.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per task and length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # at most ``capacity`` rows
    counts = {r["length"]: r["_n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("_n")).collect()}
    numbered = stored.join(starts, ["length", "part"]).withColumn("_number", F.col("_before") + F.col("nth"))
    placed = place(numbered, best_fit_plan(counts, capacity)) if counts else numbered.withColumn(
        "_at", F.struct(F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "_at.sequence_id", "_at.offset")
