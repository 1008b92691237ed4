"""Near duplicates by min-max hashing.

A document's signature holds, for each permutation, both the least and the
greatest value over its shingles: two unbiased samples for one evaluation, of
lower variance than two minima.  Rows of a band come from different permutations.

Documents of equal shingle sets share one node.  In every bucket of a band all
nodes are compared with one centre, the node that meets most others over all
bands; a large group of copies thus costs one comparison a node.  What is then
in another component than its centre is compared with the other nodes of that
centre, in blocks of fixed size.  Nodes that are loosely similar to the centre of a
bucket are compared with the rest of that bucket itself, in blocks too.  Signatures
only screen; whole shingle sets confirm every link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from stackpool.llm.common import id_filter, id_text, slices, spread_lookup, words_of
from stackpool.session import discard, materialise

#: Values of a signature (two a permutation) and values a band: at a similarity of 0.8 a pair misses all bands once in four million.
PERMUTATIONS, ROWS = 95, 5
#: How far below the threshold signatures may estimate a pair (five standard errors at 0.8), and the estimate below which
#: a node is not kept with a centre but compared within the bucket.
SLACK, FAR = 0.16, 0.5
#: Nodes of a block, and bytes of text taken at a time.
BLOCK, SLICE = 1024, 1 << 20
WORDS = 4
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: pa.Array, width: int = WORDS):
    """For each text its sorted distinct 64-bit shingle hashes."""
    which, words, many = words_of(texts)
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), dtype=_U, count=len(words))[which]
    step = _mix(np.arange(1, width + 1, dtype=_U)) | _U(1)
    ends = np.cumsum(many)
    n = len(hashed) - width + 1
    rolled = np.zeros(max(n, 0), dtype=_U)
    for j in range(width if n > 0 else 0):
        rolled += hashed[j:j + n] * step[j]
    rolled = _mix(rolled)
    for end, k in zip(ends.tolist(), many.tolist()):
        if k >= width:
            yield np.unique(rolled[end - k:end - width + 1])
        elif k:
            yield _mix((hashed[end - k:end] * step[:k]).sum(keepdims=True) + _U(k))
        else:
            yield np.zeros(0, dtype=_U)


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(2 * n, dtype=_U) + _U(seed * 1_000_003)
    m = _mix(at * _U(0x9E3779B97F4A7C15))
    return (m[:n] | _U(1))[:, None], m[n:][:, None]


def signature(shingles: np.ndarray, perms) -> np.ndarray:
    """Least and greatest value under each permutation: [min_1..min_n, max_1..max_n]."""
    values = shingles * perms[0] + perms[1]
    return np.concatenate([values.min(axis=1), values.max(axis=1)])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def sign(docs: DataFrame, width: int = WORDS, permutations_: int = PERMUTATIONS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n (set size), set_key (128 bits of the whole set), sig (a byte for each value), bands.

    An empty or null text has n = 0 and no bands.
    """
    perms = permutations(permutations_)
    bands = 2 * permutations_ // rows
    salt = _mix(np.arange(1, bands + 1, dtype=_U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                n, keys, sigs, found = [], [], [], []
                for s in shingle_sets(batch.column(1)[a:b], width):
                    n.append(len(s))
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    if not len(s):
                        sigs.append(b"")
                        found.append([])
                        continue
                    values = signature(s, perms)
                    sigs.append(_mix(values).astype(np.uint8).tobytes())
                    acc = salt.copy()
                    for row in values[:bands * rows].reshape(bands, rows).T:
                        acc = _mix(acc ^ row)
                    found.append(_signed(acc))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary()), pa.array(found, pa.list_(pa.int64()))],
                    ["doc_id", "n", "set_key", "sig", "bands"])
    texts = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(run, "doc_id long, n long, set_key binary, sig binary, bands array<long>")


def sets_of(docs: DataFrame, nodes: DataFrame, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(node, shingles) of the documents that ``nodes`` names: the sorted set as bytes of unsigned 64-bit numbers.

    A filter of the ids goes to the scan, so that sets, not texts, meet the ids.
    """
    wanted = nodes.select("node").distinct()
    may_hold = id_filter(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(batch.column(0).to_numpy(zero_copy_only=False))))
            for a, b in slices(batch.column(1), SLICE) if len(batch) else ():
                sets = [s.tobytes() for s in shingle_sets(batch.column(1)[a:b], width)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.binary())], ["node", "shingles"])
    texts = id_text(docs, id_col, text_col).filter("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    return texts.mapInArrow(run, "node long, shingles binary").join(wanted, "node", "left_semi")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity that one-byte signatures estimate; chance meetings of bytes are taken off."""
    same = (a == b).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


@F.pandas_udf(DoubleType())
def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(c), dtype=np.uint8).reshape(len(c), -1) for c in (a, b))
    return pd.Series(_agreement(x, y))


@F.pandas_udf(LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets."""
    sets = ((np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U)) for x, y in zip(a, b))
    return pd.Series([len(np.intersect1d(x, y, assume_unique=True)) for x, y in sets], dtype="int64")


def sets_for(nodes: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Whole sets of the documents named in the column node, written once."""
    return materialise(sets_of(docs, nodes, width, id_col, text_col), "sets")


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Of the pairs (x, y) those with 100 * intersection >= percent * union on whole sets."""
    sets = sets_for(pairs.select(F.explode(F.array("x", "y")).alias("node")), docs, width, id_col, text_col)
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}"))
    both = pairs.select("x", "y").join(side("x"), "x").join(side("y"), "y").withColumn("both", common("set_x", "set_y"))
    union = F.octet_length("set_x") / 8 + F.octet_length("set_y") / 8 - F.col("both")
    return both.filter(F.col("both") * 100 >= union * percent).select("x", "y").distinct()


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, label): the least node that each linked node reaches.

    Labels spread along links, then each takes the label of its label, until none
    changes.  ``labels`` may give a start (nodes and labels of an earlier call).
    Every round is written to the shared folder.
    """
    links = materialise(links.select("x", "y").union(links.select("y", "x")).filter("x <> y"), "links")
    nodes = links.select(F.col("x").alias("node")).distinct()
    if labels is None:
        now = nodes.withColumn("label", F.col("node"))
    else:
        now = nodes.join(labels, "node", "full_outer").select("node", F.coalesce("label", "node").alias("label"))
    now = materialise(now, "labels")
    while True:
        known = now.select(F.col("node").alias("x"), "label")
        heard = links.join(known, "x").groupBy(F.col("y").alias("node")).agg(F.min("label").alias("heard"))
        # what a label hears goes for all that carry it
        told = now.join(heard, "node").groupBy(F.col("label").alias("root")).agg(F.min("heard").alias("told"))
        step = (now.join(heard, "node", "left").join(told, now["label"] == told["root"], "left")
                .select("node", F.col("label").alias("before"), F.least("label", F.coalesce("heard", "label"), F.coalesce("told", "label")).alias("label")))
        step = materialise(step, "labels")
        discard(now)
        up = step.select(F.col("node").alias("root"), F.col("label").alias("above"))
        jumped = step.join(up, step["label"] == up["root"], "left").select("node", "before", F.least("label", F.coalesce("above", "label")).alias("label"))
        now = materialise(jumped, "labels")
        discard(step)
        if now.filter("before <> label").isEmpty():
            discard(links)
            return now.select("node", "label")


def centred(buckets: DataFrame) -> DataFrame:
    """(bucket, centre, node) from (bucket, node) rows, a node with the centre of each of its buckets.

    The centre is the node with the greatest sum of the sizes of all its buckets.
    """
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = materialise(buckets.join(sizes, "bucket"), "buckets")
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    chosen = shared.join(met, "node").groupBy("bucket").agg(F.max_by("node", "met").alias("centre"))
    return shared.select("bucket", "node").join(chosen, "bucket").filter("node <> centre").select("bucket", "centre", "node")


def estimated(members: DataFrame, signed: DataFrame) -> DataFrame:
    """Distinct (centre, node) rows with the similarity that signatures estimate."""
    sig = lambda name, end: signed.select(F.col("node").alias(name), F.col("sig").alias(f"sig_{end}"), F.col("n").alias(f"n_{end}"))
    both = members.join(sig("node", "x"), "node").join(sig("centre", "y"), "centre")
    return materialise(both.withColumn("near", estimate("sig_x", "sig_y")).drop("sig_x", "sig_y"), "estimated")


def loose_pairs(seats: DataFrame, held: DataFrame, signed: DataFrame, labels: DataFrame, percent: int, far: float) -> DataFrame:
    """Distinct pairs (x, y) of different components that share a bucket, not both near its centre, and that signatures let pass.

    Signatures differ by a metric, so whoever passes with a node that is far from a
    centre is itself less than ``far`` plus the difference allowed to it: the others
    need not be compared.  The far nodes are dealt out in blocks against all that are
    left; a task holds two blocks.
    """
    lowest = percent / 100 - SLACK
    rows = seats.join(held.filter(F.col("near") < far + 1 - lowest).select("centre", "node", "near"), ["centre", "node"])
    rows = rows.withColumn("far", F.col("near") < far).select("bucket", "node", "far")
    sizes = rows.groupBy("bucket").agg(F.sum(F.col("far").cast("long")).alias("many"), F.count(F.lit(1)).alias("all")).filter("many > 0 and all > 1")
    rows = materialise(rows.join(sizes, "bucket").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "loose")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    placed = rows.withColumn("alone", F.ceil(F.col("many") / BLOCK).cast("long")).withColumn("blocks", F.ceil(F.col("all") / BLOCK).cast("long"))
    left = placed.filter("far").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), "alone")).withColumn("j", each(F.col("blocks"))).withColumn("side", F.lit(0))
    right = placed.withColumn("j", F.pmod(F.xxhash64("node"), "blocks")).withColumn("i", each(F.col("alone"))).withColumn("side", F.lit(1))
    cols = ["bucket", "i", "j", "side", "node", "label", "far"]
    dealt = left.select(*cols).unionByName(right.select(*cols)).join(signed.select("node", "sig", "n"), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = (group[group.side == s] for s in (0, 1))
        out = [np.zeros((0, 2), dtype=np.int64)]
        if len(one) and len(two):
            sig, other = (np.frombuffer(b"".join(x.sig), dtype=np.uint8).reshape(len(x), -1) for x in (one, two))
            names, labs, n, distant = (two[c].to_numpy() for c in ("node", "label", "n", "far"))
            for k, (node, label, size) in enumerate(zip(one.node, one.label, one.n)):
                # two that are both far meet from either side: keep one order
                want = (labs != label) & (~distant | (names > node)) & (np.minimum(n, size) * 100 >= np.maximum(n, size) * percent)
                at = np.flatnonzero(want)
                at = at[_agreement(other[at], sig[k]) >= lowest]
                out.append(np.stack([np.minimum(names[at], node), np.maximum(names[at], node)], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["x", "y"])
    return dealt.groupBy("bucket", "i", "j").applyInPandas(compare, "x long, y long").distinct()


def rest_links(members: DataFrame, labels: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """Links among the nodes of one centre that lie in different components; one for each node and component.

    Only centres with a node outside their own component are looked at.  Their
    nodes are dealt out in blocks; a task holds two blocks and the centre.  What
    two sets share within the centre's set comes from one matrix product, and what
    they can share besides is at most the smaller rest: pairs that this bound
    leaves are confirmed on whole sets.
    """
    of = lambda name: labels.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))
    own = members.select("centre", "node").join(of("node"), "node", "left").join(of("centre"), "centre", "left")
    own = own.withColumn("label", F.coalesce("_node", "node")).withColumn("apart", F.col("label") != F.coalesce("_centre", "centre"))
    open_ = own.groupBy("centre").agg(F.sum(F.col("apart").cast("long")).alias("many"), F.count(F.lit(1)).alias("all")).filter("many > 0 and all > 1")
    rows = materialise(own.select("centre", "node", "label", "apart").join(open_, "centre"), "apart")
    sets = sets_for(rows.select(F.explode(F.array("node", "centre")).alias("node")), docs, width, id_col, text_col).dropDuplicates(["node"])
    alone, blocks = F.ceil(F.col("many") / BLOCK), F.ceil(F.col("all") / BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    placed = rows.withColumn("alone", alone.cast("long")).withColumn("blocks", blocks.cast("long"))
    # those apart are the left side, everyone is the right side
    left = placed.filter("apart").withColumn("i", F.pmod(F.xxhash64("node", F.lit(1)), "alone")).withColumn("j", each(F.col("blocks"))).withColumn("side", F.lit(0))
    right = placed.withColumn("j", F.pmod(F.xxhash64("node"), "blocks")).withColumn("i", each(F.col("alone"))).withColumn("side", F.lit(1))
    middle = (placed.select("centre", "alone", "blocks").distinct().withColumn("node", F.col("centre")).withColumn("label", F.col("centre")).withColumn("apart", F.lit(False))
              .withColumn("i", each(F.col("alone"))).withColumn("j", each(F.col("blocks"))).withColumn("side", F.lit(2)))
    cols = ["centre", "i", "j", "side", "node", "label", "apart"]
    dealt = left.select(*cols).unionByName(right.select(*cols)).unionByName(middle.select(*cols)).join(sets, "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group.side == s] for s in (0, 1, 2)]
        if not all(map(len, sides)):
            return pd.DataFrame({"x": [], "y": []}, dtype="int64")
        core = np.frombuffer(sides[2].shingles.iloc[0], dtype=_U)
        held = [[np.frombuffer(s, dtype=_U) for s in side.shingles] for side in sides[:2]]
        inside = [np.array([np.isin(core, s, assume_unique=True) for s in sets], dtype=np.float32) for sets in held]
        size = [np.array([len(s) for s in sets]) for sets in held]
        rest = [n - m.sum(axis=1) for n, m in zip(size, inside)]
        out = []
        names, labs, apart = (sides[1][c].to_numpy() for c in ("node", "label", "apart"))
        for k, (node, label) in enumerate(zip(sides[0].node, sides[0].label)):
            most = inside[1] @ inside[0][k] + np.minimum(rest[1], rest[0][k])
            # two that are both apart meet from either side: keep one order
            want = (labs != label) & (~apart | (names > node)) & (most * 100 >= (size[1] + size[0][k] - most) * percent)
            found = set()
            for m in np.flatnonzero(want).tolist():
                if labs[m] not in found:
                    both = len(np.intersect1d(held[0][k], held[1][m], assume_unique=True))
                    if both * 100 >= (size[0][k] + size[1][m] - both) * percent:
                        found.add(labs[m])
                        out.append((node, names[m]))
        return pd.DataFrame(out, columns=["x", "y"], dtype="int64")
    return dealt.groupBy("centre", "i", "j").applyInPandas(compare, "x long, y long")


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id that links reach), kept.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of ``width``-word shingles.  Fewer words are one shingle; no words, an
    empty or a null text link with nothing.  Rows of one doc_id are one document
    for reach.  A null doc_id takes no part: component_id null, kept true.
    Of exact repeats of a row all get the same values.
    """
    stored = materialise(sign(docs, width, id_col=id_col, text_col=text_col), "signed")
    full = stored.filter("n > 0 and doc_id is not null")
    first = materialise(full.groupBy("set_key").agg(F.min("doc_id").alias("node")), "firsts")
    # the row that gave the least id carries the signature: both columns deal a large group of copies out
    own = full.join(first.withColumnRenamed("node", "doc_id"), ["set_key", "doc_id"], "left_semi")
    signed = materialise(own.select(F.col("doc_id").alias("node"), "set_key", "n", "sig", "bands").dropDuplicates(["node", "set_key"]), "nodes")
    seats = materialise(centred(signed.select(F.explode("bands").alias("bucket"), "node")), "seats")
    held = estimated(seats.select("centre", "node").distinct(), signed)
    far = min(FAR, percent / 100 - SLACK)
    members = held.filter(F.col("near") >= far)
    screened = members.filter((F.col("near") >= percent / 100 - SLACK) & (F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent))
    pairs = screened.select(F.least("node", "centre").alias("x"), F.greatest("node", "centre").alias("y")).distinct()
    links = confirmed(pairs, docs, percent, width, id_col, text_col)
    # several sets under one doc_id hang together by it
    several = full.select("doc_id", "set_key").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1")
    same = full.select("doc_id", "set_key").distinct().join(several.select("doc_id"), "doc_id").join(first, "set_key").filter("doc_id <> node")
    links = materialise(links.union(same.select(F.col("node").alias("x"), F.col("doc_id").alias("y")).distinct()), "links")
    labels = components(links)
    loose = materialise(loose_pairs(seats, held, signed, labels, percent, far), "loose")
    more = rest_links(members, labels, docs, percent, width, id_col, text_col)
    if not loose.isEmpty():
        more = more.union(confirmed(loose, docs, percent, width, id_col, text_col))
    more = materialise(more, "links")
    if not more.isEmpty():
        labels = components(more.union(links), labels)
    named = materialise(first.join(labels, "node", "left"), "named")
    for t in (signed, seats, held, links, more, loose):
        discard(t)
    out = spread_lookup(stored.select("doc_id", "n", "set_key"), named, "set_key", "doc_id")
    reached = F.when(F.col("n") > 0, F.coalesce("label", "node", "doc_id")).otherwise(F.col("doc_id"))
    reached = F.when(F.col("doc_id").isNotNull(), reached)
    return out.select("doc_id", F.col("n").alias("n_shingles"), reached.alias("component_id"), F.coalesce(F.col("doc_id") == reached, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 80, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of the least doc_id of each group of near duplicates.

    Of rows that repeat one doc_id and text one stays.  Rows without doc_id all stay.
    """
    mine, copy, at = (next(f"{n}{k}" for k in range(len(docs.columns) + 1) if f"{n}{k}" not in docs.columns) for n in ("_kept", "_copies", "_once"))
    kept = near_duplicates(docs, percent, width, id_col=id_col, text_col=text_col).filter("kept and doc_id is not null").select(F.col("doc_id").alias(mine)).distinct()
    rows = docs.join(kept, F.col(id_col).cast("long") == F.col(mine), "left_semi")
    # only ids that occur twice can have rows that repeat: their texts alone are compared
    twice = materialise(docs.groupBy(F.col(id_col).cast("long").alias(mine)).agg(F.count(F.lit(1)).alias(copy)).filter(F.col(copy) > 1).select(mine), "twice")
    again = F.col(id_col).cast("long") == F.col(mine)
    once = Window.partitionBy(id_col, text_col).orderBy(F.lit(0))
    firsts = rows.join(twice, again, "left_semi").withColumn(at, F.row_number().over(once)).filter(F.col(at) == 1).drop(at)
    return rows.join(twice, again, "left_anti").unionByName(firsts).unionByName(docs.filter(F.col(id_col).isNull()))
