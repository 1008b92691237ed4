"""Count-only Viterbi segmentation under a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary matches of a chunk; dynamic
programming over its characters carries the best score and the number of pieces
of the path, no pieces.  Rules are those of the public SentencePiece unigram
encoder: a start keeps its first best way, ends take a strictly better way only
(so of equal ways the one whose last piece starts earliest, the longest last
piece, stays), and a character that no one-character piece covers may be an
unknown of score min - 10, which counts as its UTF-8 bytes where the vocabulary
has byte pieces, else as one.

White space is escaped as in that encoder; a chunk is a run of escaped blanks and
what follows up to the next.  No piece has a blank behind another character, so
the best way of a text is that of its chunks, and distinct chunks are counted once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.llm.common import id_text, slices

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS, CACHED_CHUNK = 1 << 18, 64


def read_pieces(path: str) -> tuple[list[tuple[str, float]], bool, bool]:
    """(normal pieces with scores, whether bytes stand in for unknowns, whether a blank is put first) of a model file."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    plain = [i for i in ids if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
    bytes_ = any(model.is_byte(i) for i in ids)
    return [(model.id_to_piece(i), model.get_score(i)) for i in plain], bytes_, model.encode("a", out_type=str)[0].startswith(BLANK)


class Counter:
    """Piece counts of texts under a vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool, blank_first: bool):
        for piece, _ in pieces:
            if BLANK in piece.lstrip(BLANK):
                raise ValueError(f"a blank inside the piece {piece!r}: chunks would not be independent")
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces:
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces, self.blank_first = byte_pieces, blank_first
        self.kept: dict[str, tuple[float, int]] = {}

    def chunk(self, text: str) -> tuple[float, int]:
        """(best score, pieces) of a chunk."""
        found = self.kept.get(text)
        if found is None:
            found = self._viterbi(text)
            if len(text) <= CACHED_CHUNK:
                self.kept[text] = found
        return found

    def _viterbi(self, text: str) -> tuple[float, int]:
        n = len(text)
        best, count, single = [-math.inf] * (n + 1), [0] * (n + 1), [False] * n
        best[0] = 0.0
        ending: list[list] = [[] for _ in range(n)]
        for last, (size, score) in self.pieces.iter(text):
            ending[last].append((size, score))
            if size == 1:
                single[last] = True
        for last in range(n):
            # earlier starts first, and only a better score replaces: the first of equal ways stays
            way, pieces = -math.inf, 0
            for size, score in sorted(ending[last], reverse=True):
                start = last + 1 - size
                if best[start] + score > way:
                    way, pieces = best[start] + score, count[start] + 1
            if not single[last] and best[last] + self.unknown > way:
                way, pieces = best[last] + self.unknown, count[last] + (len(text[last].encode()) if self.byte_pieces else 1)
            best[last + 1], count[last + 1] = way, pieces
        return best[n], count[n]

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text: blanks are escaped and one may be put first; an empty text has none."""
        if not text:
            return []
        escaped = (" " if self.blank_first else "") + text
        out, run = [], 0
        parts = escaped.replace(BLANK, " ").split(" ")
        if parts[0]:
            out.append(parts[0])
        for part in parts[1:]:
            run += 1
            if part:
                out.append(BLANK * run + part)
                run = 0
        return out + [BLANK * run] if run else out

    def texts(self, texts: list[str]) -> tuple[list[float], list[int]]:
        if len(self.kept) > CACHE_CHUNKS:
            self.kept = {}
        scores, counts = [], []
        for text in texts:
            ways = [self.chunk(c) for c in self.chunks(text)]
            scores.append(math.fsum(w[0] for w in ways))
            counts.append(sum(w[1] for w in ways))
        return scores, counts


_counters: dict[int, Counter] = {}


def counter(vocabulary) -> Counter:
    """One counter a worker process for a broadcast vocabulary, so that its chunks serve later tasks too."""
    key = hash((tuple(vocabulary.value[0]), *vocabulary.value[1:]))
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(*vocabulary.value)
    return _counters[key]


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, score (sum of the scores of the best pieces).

    The pieces and scores of the model file are read as a unigram vocabulary.  An
    empty or null text has no tokens and score 0.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_pieces(model_path))  # a vocabulary file, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                scores, counts = own.texts(batch.column(1)[a:b].to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "n_tokens", "score"])
    return id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, "doc_id long, n_tokens long, score double")
