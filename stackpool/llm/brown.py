"""Class-based bigram model: exchange clustering puts words into classes, and a text has the probability
of its class transitions times that of its words in their classes.

Counts of all training words come from one aggregation.  What is clustered is a
bounded set of units: the words with at least N / UNIT_SHARE tokens (no more than
UNIT_SHARE such words can be), and for all other words the endings with at least
N / ENDING_SHARE tokens, and one unit for the rest.  So every word, seen or not,
has a class, while its probability inside the class uses its own exact count.

An exchange round moves units to the class that raises the likelihood of the
class bigrams most, judged for all units at once from one table of class counts;
of these moves a round makes those of half of the units, in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackpool.llm.common import id_crc, id_text, slices, task_number, words_of
from stackpool.session import materialise

CLASSES, ROUNDS = 64, 12
UNIT_SHARE, ENDING_SHARE, HEAVY_SHARE = 1 << 14, 1 << 12, 1 << 20
#: Weight of the class frequencies beside the counted transitions of a class.
PRIOR_WEIGHT = 16.0
END = ""  # no word is empty


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; the end of each text counts as the token END."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 16 << 20):
                which, words, _ = words_of(batch.column(1)[a:b])
                counts = np.bincount(which, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.array(np.append(counts, b - a), pa.int64())], ["word", "c"])
    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Numbers of the clustered units: 0 the end, then frequent words, then endings, then all other words."""

    def __init__(self, words: list[str], endings: list[str]):
        self.words, self.endings = pa.array(words, pa.string()), pa.array(endings, pa.string())
        self.size = 2 + len(words) + len(endings)

    def of(self, words: pa.Array) -> np.ndarray:
        def number(found, first):
            at = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
            return np.where(at >= 0, at + first, -1)
        own = number(pc.index_in(words, value_set=self.words), 1)
        tail = number(pc.index_in(pc.utf8_slice_codeunits(words, -2), value_set=self.endings), 1 + len(self.words))
        return np.where(own >= 0, own, np.where(tail >= 0, tail, self.size - 1))


def with_ends(values: np.ndarray, many: np.ndarray, end) -> np.ndarray:
    """One value a token: those of the words, and ``end`` after each text."""
    return np.insert(values, np.cumsum(many), end)


def unit_bigrams(texts: DataFrame, units) -> DataFrame:
    """(u, v, n): how often unit v follows unit u; a text begins after an end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = units.value.size
        for batch in batches:
            for a, b in slices(batch.column(1)):
                which, words, many = words_of(batch.column(1)[a:b])
                flat = with_ends(units.value.of(words)[which] if len(words) else which, many, 0)
                code, n = np.unique(np.concatenate([[0], flat[:-1]]) * size + flat, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code // size), pa.array(code % size), pa.array(n.astype(np.int64))], ["u", "v", "n"])
    return texts.mapInArrow(run, "u long, v long, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def best_class(counts: np.ndarray, right: np.ndarray, left: np.ndarray, own: float, now: int) -> tuple[int, float]:
    """Where a unit raises the likelihood most, and by how much over its class ``now``.

    ``right`` / ``left`` count the unit's next / previous classes with the unit
    still in ``now``; ``own`` how often it follows itself.
    """
    n = counts.copy()
    right, left = right.copy(), left.copy()
    n[now] -= right
    n[:, now] -= left
    n[now, now] += own
    right[now] -= own
    left[now] -= own
    inside = np.diag(n)
    rows = _xlogx(n + right) - _xlogx(n)
    cols = _xlogx(n + left[:, None]) - _xlogx(n)
    gain = rows.sum(axis=1) - np.diag(rows) + cols.sum(axis=0) - np.diag(cols) + _xlogx(inside + right + left + own) - _xlogx(inside)
    # all that the members of a class are followed by and follow, the unit included
    out, into = n.sum(axis=1) + left, n.sum(axis=0) + right
    gain -= _xlogx(out + right.sum() + own) - _xlogx(out) + _xlogx(into + left.sum() + own) - _xlogx(into)
    gain[0] = -np.inf  # the end stays alone
    best = int(np.argmax(gain))
    return best, float(gain[best] - gain[now])


def _neighbour_classes(batch: pa.RecordBatch, side: str, classes: np.ndarray, size: int) -> np.ndarray:
    """How often each row's unit meets each class on one side."""
    others, n = (batch.column(batch.schema.get_field_index(f"{side}_{x}")) for x in ("o", "n"))
    many = pc.fill_null(pc.list_value_length(others), 0).to_numpy(zero_copy_only=False)
    cell = np.repeat(np.arange(len(many)) * size, many) + classes[others.flatten().to_numpy(zero_copy_only=False)]
    return np.bincount(cell, weights=n.flatten().to_numpy(zero_copy_only=False), minlength=len(many) * size).reshape(len(many), size)


def class_counts(adjacent: DataFrame, classes: np.ndarray, size: int) -> np.ndarray:
    """Counts of class bigrams; each task sends one table of size x size."""
    held = adjacent.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        total = np.zeros((size, size))
        for batch in batches:
            np.add.at(total, held.value[batch.column(0).to_numpy()], _neighbour_classes(batch, "after", held.value, size))
        yield pa.RecordBatch.from_pydict({"table": [total.tobytes()]})
    parts = adjacent.select("unit", "after_o", "after_n").mapInArrow(run, "table binary").collect()
    return sum((np.frombuffer(r["table"]).reshape(size, size) for r in parts), np.zeros((size, size)))


def proposals(adjacent: DataFrame, classes: np.ndarray, counts: np.ndarray, turn: int) -> list:
    """(unit, class, gain) for the units whose turn it is and that gain by a move; at most one row a unit."""
    held = adjacent.sparkSession.sparkContext.broadcast((classes, counts))

    def run(batches):
        classes, counts = held.value
        size, out = len(counts), []
        for batch in batches:
            right, left = (_neighbour_classes(batch, side, classes, size) for side in ("after", "before"))
            for unit, own, r, l in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), right, left):
                best, gain = best_class(counts, r, l, float(own), int(classes[unit]))
                if gain > 1e-6:
                    out.append((unit, best, gain))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["unit", "best", "gain"])
    mine = adjacent.filter((F.col("unit") > 0) & (F.col("unit") % 2 == turn))
    return mine.select("unit", "own", "after_o", "after_n", "before_o", "before_n").mapInArrow(run, "unit long, best long, gain double").collect()


def likelihood(counts: np.ndarray) -> float:
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=1)).sum() - _xlogx(counts.sum(axis=0)).sum())


def cluster(bigrams: DataFrame, n_units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each unit, counts of class bigrams) by exchange clustering; class 0 is the end alone.

    The best assignment seen is kept, as moves made at once can disturb each other.
    """
    pair = lambda o: F.collect_list(F.struct(F.col(o).alias("o"), "n"))  # noqa: E731  at most one entry a unit
    side = lambda own, o, name: (bigrams.groupBy(F.col(own).alias("unit")).agg(pair(o).alias("x"))
                                 .select("unit", F.col("x.o").alias(f"{name}_o"), F.col("x.n").alias(f"{name}_n")))
    own = bigrams.filter("u = v").select(F.col("u").alias("unit"), F.col("n").alias("own"))
    joined = side("u", "v", "after").join(side("v", "u", "before"), "unit", "full_outer").join(own, "unit", "left")
    adjacent = materialise(joined.withColumn("own", F.coalesce("own", F.lit(0))).repartition(F.col("unit")), "adjacent")
    now = np.concatenate([[0], 1 + np.arange(n_units - 1) % (classes - 1)])
    counts = class_counts(adjacent, now, classes)
    best, best_counts = now, counts
    for r in range(rounds):
        moved = now.copy()
        for row in proposals(adjacent, now, counts, r % 2):
            moved[row["unit"]] = row["best"]
        now = moved
        counts = class_counts(adjacent, now, classes)
        if likelihood(counts) > likelihood(best_counts):
            best, best_counts = now, counts
    return best, best_counts


class Model:
    """What scoring needs besides the counts of rare words; its size does not depend on the input."""

    def __init__(self, tokens: int, words: int, units: Units, classes: np.ndarray, counts: np.ndarray, discount: float, distinct: np.ndarray, unseen_types: float):
        self.tokens, self.words, self.units, self.classes = tokens, words, units, classes
        size = len(counts)
        out, into = counts.sum(axis=1), counts.sum(axis=0)
        prior = (into + 1) / (into.sum() + size)
        self.transition = np.log10((counts + PRIOR_WEIGHT * prior) / (out[:, None] + PRIOR_WEIGHT))
        # only classes with endings can meet an unseen word
        open_ = np.zeros(size, dtype=bool)
        open_[classes[1 + len(units.words):]] = True
        self.discount = np.where(open_, discount, 0.0)
        total = np.maximum(into, 1.0)
        self.log_total = np.log10(total)
        # what is discounted goes to the words not seen, as many in a class as it has of the seen ones
        self.unseen_types = np.maximum(unseen_types * distinct / max(distinct[open_].sum(), 1), 1.0)
        unseen = np.where(distinct > 0, self.discount * distinct / total, 1.0) / self.unseen_types
        self.unseen = np.log10(np.maximum(unseen, 1e-300))
        self.base_norm = float(np.log10(tokens + words + 1))

    def emission(self, c: np.ndarray, k: np.ndarray) -> np.ndarray:
        """log10 of the probability of words with training counts ``c`` in their classes ``k``."""
        return np.where(c > 0, np.log10(np.maximum(c - self.discount[k], 1e-9)) - self.log_total[k], self.unseen[k])


def train(texts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model | None, DataFrame, pa.Table]:
    """(model, all word counts, the heavy words with their counts); no model without training texts."""
    spark = texts.sparkSession
    counts = materialise(word_counts(texts), "word-counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum((F.col("c") == 1).cast("long")).alias("n1"),
                       F.sum((F.col("c") == 2).cast("long")).alias("n2")).first()
    n = total["n"] or 0
    heavy = counts.filter(F.col("c") * HEAVY_SHARE >= n).orderBy(F.col("c").desc(), "word").toArrow()  # at most HEAVY_SHARE rows
    if not n:
        return None, counts, heavy
    frequent = [w for w, c in zip(heavy["word"].to_pylist(), heavy["c"].to_pylist()) if c * UNIT_SHARE >= n and w != END]
    rare = counts.filter((F.col("c") * UNIT_SHARE < n) & (F.col("word") != END))
    ends = rare.groupBy(F.right("word", F.lit(2)).alias("ending")).agg(F.sum("c").alias("c")).filter(F.col("c") * ENDING_SHARE >= n)
    units = Units(frequent, [r["ending"] for r in ends.orderBy(F.col("c").desc(), "ending").collect()])  # at most ENDING_SHARE rows
    held = spark.sparkContext.broadcast(units)
    groups, table = cluster(materialise(unit_bigrams(texts, held), "bigrams"), units.size, classes, rounds)
    known = spark.sparkContext.broadcast(groups)

    def distinct(batches):
        total = np.zeros(classes, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(known.value[held.value.of(batch.column(0))], minlength=classes)
        yield pa.RecordBatch.from_pydict({"n": [total.tobytes()]})
    parts = counts.filter(F.col("word") != END).select("word").mapInArrow(distinct, "n binary").collect()  # one small row a task
    words = sum((np.frombuffer(r["n"], dtype=np.int64) for r in parts), np.zeros(classes, dtype=np.int64))
    discount = total["n1"] / (total["n1"] + 2 * total["n2"]) if total["n1"] and total["n2"] else 0.5
    # at least so many words are left to see, by those seen once and twice
    unseen = total["n1"] ** 2 / (2 * total["n2"]) if total["n2"] else total["n1"] * (total["n1"] - 1) / 2
    return Model(n, total["v"], units, groups, table, discount, words, max(unseen, 1.0)), counts, heavy


_SCORED = ("row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<string>, rare_class array<int>, rare_n array<int>")


def _score_common(docs: DataFrame, model, heavy) -> DataFrame:
    """Per text what heavy words and transitions give, and its other words with their class and frequency."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = model.value, heavy.value
        names, freq = table["word"].combine_chunks(), table["c"].to_numpy()
        end_count, row = int(freq[pc.index(names, END).as_py()]), task_number() << 33
        for batch in batches:
            for a, b in slices(batch.column(1)):
                which, words, many = words_of(batch.column(1)[a:b])
                kind = m.classes[m.units.of(words)] if len(words) else np.zeros(0, dtype=np.int64)
                at = pc.fill_null(pc.index_in(words, value_set=names), -1).to_numpy(zero_copy_only=False)
                c = np.where(at >= 0, freq[at], 0)
                known = at >= 0
                flat = with_ends(kind[which], many, 0)
                moves = m.transition[np.concatenate([[0], flat[:-1]]), flat]
                said = np.where(known, m.emission(c, kind), 0.0)[which]
                based = np.where(known, np.log10(c + 1.0) - m.base_norm, 0.0)[which]
                ends = np.cumsum(many + 1)
                starts = ends - many - 1
                total = lambda x: np.add.reduceat(x, starts) if len(starts) else x
                score = total(moves + with_ends(said, many, 0.0))
                base = total(with_ends(based, many, np.log10(end_count + 1.0) - m.base_norm))
                n_known = total(with_ends(known[which].astype(np.int64), many, int(end_count > 0)))
                # the other words of each text, a word once
                owner = np.repeat(np.arange(len(many)), many)[~known[which]]
                code, n = np.unique(owner * max(len(words), 1) + which[~known[which]], return_counts=True)
                who, word = code // max(len(words), 1), code % max(len(words), 1)
                cuts = pa.array(np.searchsorted(who, np.arange(len(many) + 1)).astype(np.int32))
                lists = lambda x: pa.ListArray.from_arrays(cuts, x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(b - a)), batch.column(0)[a:b], pa.array(many + 1), pa.array(n_known), pa.array(base), pa.array(score),
                     lists(words.take(pa.array(word))), lists(pa.array(kind[word].astype(np.int32))), lists(pa.array(n.astype(np.int32)))],
                    ["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "rare_class", "rare_n"])
                row += b - a
    return docs.mapInArrow(run, _SCORED)


def score_texts(docs: DataFrame, training: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every text by a model of the training texts: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words, A-Z lowered, then one end.  base_score adds log10((c+1) / (N+V+1));
    score is the model's log10 probability.  In its class an unseen word has its
    share of the discounted mass of the class, by an estimate of the words not seen.  An empty or null text is one end.  One row per
    input row, also for repeated ones.  Without training texts both scores are
    n_tokens * log10(1 / 1) = 0.
    """
    spark = docs.sparkSession
    plain = lambda df: id_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    model, counts, heavy = train(plain(training), classes, rounds)
    if model is None:
        def empty(batches):
            for batch in batches:
                many = words_of(batch.column(1))[2] + 1 if len(batch) else np.zeros(0, dtype=np.int64)
                zero = np.zeros(len(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(many), *(pa.array(zero.astype(np.int64)) for _ in range(2)), pa.array(zero), pa.array(zero)],
                                                 ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        return plain(docs).mapInArrow(empty, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    held = spark.sparkContext.broadcast(model)
    scored = materialise(_score_common(plain(docs), held, spark.sparkContext.broadcast(heavy)), "scored")
    zipped = F.explode(F.arrays_zip("rare", "rare_class", "rare_n")).alias("w")
    rare = scored.select("row", zipped).select("row", F.col("w.rare").alias("word"), F.col("w.rare_class").alias("k"), F.col("w.rare_n").alias("n"))
    light = counts.filter(F.col("c") * HEAVY_SHARE < model.tokens)
    per_class = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("k") + 1)
    met = rare.join(light, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    emission = F.when(F.col("c") > 0, F.log10(F.greatest(F.col("c") - per_class(model.discount), F.lit(1e-9))) - per_class(model.log_total)).otherwise(per_class(model.unseen))
    more = met.groupBy("row").agg(F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - F.lit(model.base_norm))).alias("more_base"),
                                  F.sum(F.col("n") * emission).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = scored.select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(more, "row", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_tokens", plus("n_known", "more_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
                      plus("base", "more_base").alias("base_score"), plus("score", "more").alias("score"))


def held_out(remainder: int, modulus: int, id_col: str = "doc_id"):
    return id_crc(id_col) % modulus == remainder
