"""Byte-level byte-pair encoding and decoding with DuckDB queries inside the tasks.

Encoding splits a text by the pattern and encodes each distinct match once: a
recursive query holds one row per token position, joins neighbours with the merge
table and contracts the least-ranked pair of each word until no pair is left.
Decoding joins the ids with the vocabulary and aggregates their bytes in order.

The rows of a query are bounded: after a number of steps that follows from its
letters, words that are not done go on in another query from where they stand.

A long word is cut into blocks that overlap; each is contracted by itself, and two
neighbours are joined at a token that both have at the same place.  That is exact.
Contraction inside two tokens that end up side by side never looks beyond them, so
a row of tokens is the encoding of its bytes if and only if every two neighbours
are the encoding of theirs; and every two neighbours of the joined row are
neighbours in some block.  Where no token is shared, a block that starts at a token
bridges the gap, twice as long each time, up to the whole word.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.llm.common import id_text, slices

#: Words kept between slices (twice over), and the length up to which they are; others are encoded again.
CACHE_WORDS, CACHED_WORD = 3 << 17, 64
#: Words of one query, and bytes of text taken at a time.
QUERY_WORDS, SLICE = 50_000, 6 << 20
#: Letters and, about, rows of all steps of one query.
QUERY_LETTERS, QUERY_ROWS = 500_000, 6_000_000
#: Characters beyond which a word is encoded by blocks; bytes of a block, and from one block to the next.
LONG_WORD, BLOCK, STRIDE = 128, 128, 96
#: Ids decoded by one query.
DECODE_IDS = 1 << 20

_LAST = ("select t.word, list(tok order by pos) as ids, any_value(t.step) as step from t join (select word, max(step) as step from t group by word) l "
         "on t.word = l.word and t.step = l.step group by t.word")
# the leftmost pair of least rank of every word: a key holds rank and place, nxt the place of the token behind (-1: none)
_ENCODE = f"""
with recursive t(word, pos, tok, nxt, step) as (
    select word, pos, tok, lead(pos, 1, -1) over (partition by word order by pos), 0 from letters
    union all
    select n.word, n.pos, case when n.pos = g.at then g.best else n.tok end, case when n.pos = g.at then g.after else n.nxt end, n.step + 1
    from t n join (
        select word, (min(key) >> 20)::int as best, (min(key) & 1048575)::int as at, arg_min(behind, key) as gone, arg_min(after, key) as after from (
            select x.word, y.pos as behind, y.nxt as after, (m.merged::bigint << 20) + x.pos as key
            from t x join t y on y.word = x.word and y.pos = x.nxt join merges m on m.a = x.tok and m.b = y.tok) group by word) g on n.word = g.word
    where n.pos <> g.gone and n.step < getvariable('steps')
)
{_LAST}"""
# all pairs of least rank of every word in one step, the leftmost first where they overlap: equal to one at a time, since a
# contraction never makes a pair of lower rank if every entry of the vocabulary encodes to itself
_ENCODE_LONG = f"""
with recursive t(word, pos, tok, step) as (
    select word, pos, tok, 0 from letters
    union all
    select word, pos, case when here then best else tok end, step + 1 from (
        select *, lag(here, 1, false) over (partition by word order by pos) as gone from (
            select *, hit and sum(hit::int) over (partition by word, run order by pos) % 2 = 1 as here from (
                select *, sum((not hit)::int) over (partition by word order by pos) as run from (
                    select *, coalesce(merged = best, false) as hit from (
                        select *, min(merged) over (partition by word) as best from (
                            select n.*, m.merged
                            from (select *, lead(tok) over (partition by word order by pos) as next from t where step < getvariable('steps')) n
                            left join merges m on m.a = n.tok and m.b = n.next)))))
        where best is not null)
    where not gone
)
{_LAST}"""
_DECODE = "select doc, string_agg(piece, '' order by pos) as piece from given join vocabulary using (tok) group by doc"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Coder:
    """A DuckDB connection with the vocabulary and all pairs that merge (two tokens whose bytes together are a token)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        # a byte is the character of its number, so that bytes are text for DuckDB
        vocabulary = pa.table({"tok": pa.array(list(ranks.values()), pa.int32()), "piece": [b.decode("latin-1") for b in ranks]})
        self.db.register("given", vocabulary)
        self.db.execute("create table vocabulary as select * from given")
        self.db.execute("""create table merges as
            select l.tok as a, r.tok as b, w.tok as merged
            from (select *, unnest(range(1, length(piece))) as cut from vocabulary where length(piece) > 1) w
            join vocabulary l on l.piece = left(w.piece, w.cut) join vocabulary r on r.piece = substr(w.piece, w.cut + 1)""")
        self.db.unregister("given")
        self.letter = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.width[list(ranks.values())] = list(map(len, ranks))
        # words of late, and those before them
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, ids of each word); each word is encoded by itself."""
        if len(self.kept) > CACHE_WORDS:
            self.kept, self.older = {}, self.kept
        own, new = {}, []
        for w in words:
            if w not in self.kept:
                if w in self.older:
                    self.kept[w] = self.older[w]
                else:
                    new.append(w)
        short, long = [w for w in new if len(w) <= LONG_WORD], [w for w in new if len(w) > LONG_WORD]
        own.update(self._contracted(_ENCODE, short))
        own.update(zip(long, self._by_blocks([w.encode() for w in long])))
        found = [own[w] if w in own else self.kept[w] for w in words]
        self.kept.update((w, ids) for w, ids in own.items() if len(w) <= CACHED_WORD)
        return np.frombuffer(b"".join(found), dtype="<i4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4

    def _contracted(self, query: str, words: list[str]) -> dict[str, bytes]:
        return dict(zip(words, self._fixpoints(query, [w.encode() for w in words])))

    def _fixpoints(self, query: str, raw: list[bytes]) -> list[bytes]:
        """Ids of each byte string, contracted until no pair is left."""
        out = [b""] * len(raw)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        block = (np.cumsum(lengths) // QUERY_LETTERS) * len(raw) + np.arange(len(raw)) // QUERY_WORDS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(raw)]
        for a, b in zip(cuts, cuts[1:]):
            which, sizes = np.arange(a, b), lengths[a:b]
            flat = self.letter[np.frombuffer(b"".join(raw[a:b]), dtype=np.uint8)]
            while len(which):
                # a word of n letters makes at most n (n + 1) / 2 rows
                whole = int((sizes * (sizes + 1) // 2).sum()) <= QUERY_ROWS
                steps = int(sizes.max()) + 1 if whole else max(4, QUERY_ROWS // int(sizes.sum()))
                order, flat, sizes, last = self._steps(query, flat, sizes, steps)
                which, ends = which[order], np.cumsum(sizes)
                data, done = flat.tobytes(), last < steps
                for i, x, y, final in zip(which.tolist(), (4 * (ends - sizes)).tolist(), (4 * ends).tolist(), done.tolist()):
                    if final:
                        out[i] = data[x:y]
                flat, which, sizes = flat[np.repeat(~done, sizes)], which[~done], sizes[~done]
        return out

    def _steps(self, query: str, flat: np.ndarray, sizes: np.ndarray, steps: int) -> tuple[np.ndarray, ...]:
        """After at most ``steps`` steps: numbers of the words as they come back, their tokens in a row, tokens of each, steps of each."""
        self.db.register("letters", pa.table({
            "word": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
            "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32), "tok": flat}))
        self.db.execute(f"set variable steps = {steps}")
        found = self.db.sql(query).to_arrow_table()
        self.db.unregister("letters")
        ids = found["ids"].combine_chunks()
        return (found["word"].to_numpy(), ids.flatten().to_numpy().astype("<i4"),
                ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), found["step"].to_numpy())

    def _by_blocks(self, words: list[bytes]) -> list[bytes]:
        """Ids of each long word."""
        out: list[bytes] = []
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(words)]
        for a, b in zip(cuts, cuts[1:]):
            blocks = list(dict.fromkeys(w[at:at + BLOCK] for w in words[a:b] for at in _starts(w)))
            known = dict(zip(blocks, self._fixpoints(_ENCODE, blocks)))
            out += [self._joined(w, known) for w in words[a:b]]
        return out

    def _joined(self, word: bytes, known: dict[bytes, bytes]) -> bytes:
        """Ids of a word from those of its blocks."""
        parts, at, tail = [], 0, np.frombuffer(known[word[:BLOCK]], dtype="<i4")
        for start in _starts(word)[1:]:
            end = min(start + BLOCK, len(word))
            if at + int(self.width[tail].sum()) >= end:
                continue  # a bridge went as far
            head = np.frombuffer(known[word[start:end]], dtype="<i4")
            kept = self._shared(tail, at, head, start)
            tries = len(tail) // 2
            while kept is None:
                start = at + int(self.width[tail[:tries]].sum())
                end = min(max(end, start + 2 * (end - start)), len(word))
                piece = word[start:end]
                if piece not in known:
                    known[piece] = self._fixpoints(_ENCODE if len(piece) <= 4 * BLOCK else _ENCODE_LONG, [piece])[0]
                head = np.frombuffer(known[piece], dtype="<i4")
                kept = self._shared(tail, at, head, start)
                if kept is None and tries == 0 and end == len(word):
                    return self._fixpoints(_ENCODE_LONG, [word])[0]
                tries //= 2
            parts.append(tail[:kept[0]])
            at, tail = start + int(self.width[head[:kept[1]]].sum()), head[kept[1]:]
        return np.concatenate([*parts, tail]).astype("<i4").tobytes()

    def _shared(self, a: np.ndarray, a_at: int, b: np.ndarray, b_at: int) -> tuple[int, int] | None:
        """Places of the first token that stands in both rows of tokens at the same place of the word."""
        a_starts, b_starts = a_at + np.cumsum(self.width[a]) - self.width[a], b_at + np.cumsum(self.width[b]) - self.width[b]
        _, i, j = np.intersect1d(a_starts, b_starts, assume_unique=True, return_indices=True)
        same = np.flatnonzero(a[i] == b[j])
        return (int(i[same[0]]), int(j[same[0]])) if len(same) else None

    def decode(self, lists: pa.Array) -> list[bytes]:
        """Bytes of each list of ids."""
        tokens = lists.flatten()
        owner = np.repeat(np.arange(len(lists), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
        self.db.register("given", pa.table({"doc": owner, "tok": tokens, "pos": np.arange(len(tokens), dtype=np.int32)}))
        found = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("given")
        out = [b""] * len(lists)
        for doc, piece in zip(found["doc"].to_pylist(), found["piece"].to_pylist()):
            out[doc] = piece.encode("latin-1")
        return out


def _starts(word: bytes) -> range:
    """Where the blocks of a word start; the last one reaches its end."""
    return range(0, max(1, len(word) - BLOCK + STRIDE), STRIDE)


_coders: dict[int, Coder] = {}


def coder(ranks) -> Coder:
    """One coder a worker process for a broadcast vocabulary, so that its words serve later tasks too."""
    key = hash(frozenset(ranks.value.items()))
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks.value)
    return _coders[key]


def _encoded(batches: Iterator[pa.RecordBatch], ranks, pattern: str) -> Iterator[pa.RecordBatch]:
    import regex
    split, own = regex.compile(pattern), coder(ranks)
    for batch in batches:
        for a, b in slices(batch.column(1), SLICE):
            parts = [split.findall(t) for t in batch.column(1)[a:b].to_pylist()]
            many = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            coded = pa.array(itertools.chain.from_iterable(parts), pa.string(), size=int(many.sum())).dictionary_encode()
            del parts
            flat, sizes = own.encode_words(coded.dictionary.to_pylist())
            which = coded.indices.to_numpy().astype(np.int64)
            long = sizes[which]
            ends = np.cumsum(long)
            ids = flat[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + long, long) + np.arange(int(long.sum()))] if len(which) else flat
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids, pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], ranks) -> Iterator[pa.RecordBatch]:
    own = coder(ranks)
    known = np.zeros(max(ranks.value.values()) + 1, dtype=bool)
    known[list(ranks.value.values())] = True
    for batch in batches:
        lists = batch.column(1)
        flat = lists.flatten().to_numpy()
        if len(flat) and not (flat.min() >= 0 and flat.max() < len(known) and known[flat].all()):
            raise ValueError("an id is not in the vocabulary")
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        block = (np.cumsum(sizes) - sizes) // DECODE_IDS
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], lists[a:b], pa.array(own.decode(lists[a:b]), pa.binary())], ["doc_id", "ids", "bytes"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))


def _shared(df: DataFrame, ranks_path: str):
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary file, whatever the input


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids (a list).

    Each match of ``pattern`` is encoded by itself; no special tokens.  An empty
    or null text has no ids.  Texts and words of any length are encoded whole.
    """
    ranks = _shared(docs, ranks_path)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: _encoded(batches, ranks, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, ids and their bytes.  No ids or null give no bytes; an unknown id raises ValueError."""
    ranks = _shared(encoded, ranks_path)
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(lambda batches: _decoded(batches, ranks), "doc_id long, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``: doc_id, ids, bytes.  One worker does both, and the ids cross to it once."""
    ranks = _shared(docs, ranks_path)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: _decoded(_encoded(batches, ranks, pattern), ranks),
                                                     "doc_id long, ids array<int>, bytes binary")


def digest(decoded: DataFrame) -> DataFrame:
    """The query's columns from the operator's rows."""
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
                          F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))
