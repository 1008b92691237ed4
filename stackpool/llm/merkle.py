"""Merkle manifest of a table: stored levels of digests, and proofs that a recursive query climbs.

Rows are leaves of one tree a group, whose roots are the leaves of one tree above.
Every STRIDE levels of a tree are built at once from runs of 2^STRIDE consecutive
nodes and stored as rows (tree, tier, pos): digest, link to the parent (the next
tier's row that the run makes) and the siblings met on the way there.  A recursive
query starts at every leaf and follows the links, appending siblings and folding the
digest, through the group's root up to the manifest's.  A step climbs STRIDE
levels, so a billion rows take four steps, and only the small tiers above the
leaves are joined.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackpool.operators.order import global_index
from stackpool.session import materialise

#: Levels that one stored tier spans: a run of 2^STRIDE digests is built in one task.
STRIDE = 10
#: Numbers of the tree over the roots of all others, and of what its root links to.
TOP, END = -1, -2
_NO_LIMIT = {"spark.sql.cteRecursionRowLimit": "-1"}
_LINK = ["tree", "tier", "pos", "up_tree", "up_tier", "up_pos", "path"]
_BUILT = "doc_id long, leaf binary, seen binary, tree long, tier int, pos long, up_tree long, up_tier int, up_pos long, path array<struct<left:binary,right:binary>>, digest binary, size long"


def _field(value: Column) -> Column:
    """A value of a leaf: `-` if null, else its UTF-8 length, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[_field(f) for f in fields]), 256)


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def climb_run(digests: list[str], arity: int) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root of a run of consecutive digests, and for each of them the siblings (left, right) of every level up to it."""
    paths: list[list[tuple[str, str]]] = [[] for _ in digests]
    level, under = list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, owners = [], []
        for a in range(0, len(level), arity):
            group = level[a:a + arity]
            for k in range(len(group)):
                met = ("".join(group[:k]), "".join(group[k + 1:]))
                for i in under[a + k]:
                    paths[i].append(met)
            above.append(_digest("".join(group)))
            owners.append([i for part in under[a:a + arity] for i in part])
        level, under = above, owners
    return level[0], paths


def _tier(nodes: DataFrame, run: int, arity: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """(linked rows, next tier's nodes) from nodes (doc_id, seen, tree, tier, pos, digest, size), ``size`` counting the tree's nodes on that tier.

    The last run of a tree climbs ``levels`` levels like the others, also where it has
    fewer nodes: one left alone goes through them hashed by itself.  A tree of one
    run ends when one node remains, and links to its place in the tree above.
    """
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree, tier, size = int(pdf.tree.iloc[0]), int(pdf.tier.iloc[0]), int(pdf["size"].iloc[0])
        root, paths = climb_run([d.hex() for d in pdf.digest], arity)
        pos = pdf.pos.to_numpy()
        up = (tree, tier + 1, int(pos[0]) // run)
        if size > run:
            for _ in range(levels - len(paths[0])):
                root = _digest(root)
        else:
            up = (END, 0, 0) if tree == TOP else (TOP, 0, tree)
        linked = [[{"left": bytes.fromhex(a), "right": bytes.fromhex(b)} for a, b in p] for p in paths]
        if size > run:
            alone = [{"left": b"", "right": b""}] * (levels - len(paths[0]))
            linked = [p + alone for p in linked]
        return pd.DataFrame({"doc_id": pdf.doc_id, "leaf": pdf.digest, "seen": pdf.seen, "tree": tree, "tier": tier, "pos": pos, "up_tree": up[0], "up_tier": up[1],
                             "up_pos": up[2], "path": linked, "digest": [bytes.fromhex(root)] * len(pos), "size": -(-size // run)})
    runs = nodes.groupBy("tree", F.floor(F.col("pos") / run).alias("run"))
    made = materialise(runs.applyInPandas(build, _BUILT), "merkle")
    above = made.filter(F.col("pos") % run == 0).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("seen"), "tree", (F.col("tier") + 1).alias("tier"),
        F.floor(F.col("pos") / run).alias("pos"), "digest", "size")
    return made, above


def _forest(nodes: DataFrame, stride: int, arity: int) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(rows of tier 0, rows of each tier above, roots as (tree, digest)) of trees given by their nodes of tier 0."""
    run = arity ** stride
    tiers, roots, left = [], None, nodes
    while True:
        made, above = _tier(left, run, arity, stride)
        tiers.append(made)
        done = above.filter("size = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        left = above.filter("size > 1")
        if left.isEmpty():
            return tiers[0], tiers[1:], roots


def _positions(rows: DataFrame, group: str, order: list) -> DataFrame:
    """Adds ``tree`` (number of the group, in its order), ``pos`` in the group and ``size`` of the group."""
    indexed = global_index(rows, [F.col(group).cast("binary").asc_nulls_first(), *order], "_at", "leaves")
    spans = indexed.groupBy(F.col(group).alias("_group")).agg(F.min("_at").alias("_least"), F.count(F.lit(1)).alias("size"))
    numbered = global_index(spans, [F.col("_group").cast("binary").asc_nulls_first()], "tree", "groups")
    return indexed.join(numbered, F.col(group).eqNullSafe(F.col("_group"))).withColumn("pos", F.col("_at") - F.col("_least")).drop("_at", "_least", "_group")


def _recursive(spark: SparkSession, sql: str, tag: str, **views: DataFrame) -> DataFrame:
    """Result of a recursive query, written; the number of its rows has no limit."""
    before = {k: spark.conf.get(k, None) for k in _NO_LIMIT}
    try:
        for k, v in _NO_LIMIT.items():
            spark.conf.set(k, v)
        return materialise(spark.sql(sql, **views), tag)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def manifest(docs: DataFrame, fields: list[str], group: str = "lang", id_col: str = "doc_id", stride: int = STRIDE, arity: int = 2,
             tampered: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof, folded_root, verified.

    A leaf is the digest of ``fields``.  Leaves of a group ascend by ``id_col`` (nulls
    first; ties by digest); every ``arity`` consecutive nodes make one of the next
    level until one remains, the subroot.  Subroots in the order of their groups (null
    first, bytewise) make the root likewise.  ``proof`` holds the siblings of a leaf, left
    to right and level by level, joined.  ``tampered`` names fields that the check
    sees changed: ``folded_root`` is what the changed leaf and the siblings give, and
    ``verified`` says whether that is the root.  Nulls and empty texts have digests
    like any value; rows that repeat are leaves of their own; an empty table gives no row.
    """
    spark = docs.sparkSession
    changed = tampered or {}
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(group).cast("string").alias("_group_of"),
                       F.unhex(leaf_digest([F.col(f) for f in fields])).alias("digest"),
                       F.unhex(leaf_digest([changed.get(f, F.col(f)) for f in fields])).alias("seen"))
    # a leaf that is seen as it is needs no second digest
    rows = rows.withColumn("seen", F.nullif("seen", "digest"))
    tier0 = F.lit(0).alias("tier")
    placed = _positions(rows, "_group_of", [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("seen")])
    leaves, tiers, subroots = _forest(placed.select("doc_id", "seen", "tree", tier0, "pos", "digest", "size"), stride, arity)
    subroots = materialise(subroots, "subroots")
    many = subroots.count()
    if not many:
        none = F.lit(None).cast("string")
        return leaves.select("doc_id", *[none.alias(c) for c in ("leaf", "subroot", "root", "proof", "folded_root")], F.lit(False).alias("verified"))
    # the trees are numbered in the order of their groups
    over = subroots.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("seen"), F.lit(TOP).cast("long").alias("tree"), tier0,
                           F.col("tree").alias("pos"), "digest", F.lit(many).cast("long").alias("size"))
    first, more, roots = _forest(over, stride, arity)
    root = roots.first()["digest"].hex()
    nodes = first
    for t in (*tiers, *more):
        nodes = nodes.unionByName(t)
    stored = materialise(nodes.select(*_LINK), "nodes")
    fold = "unhex(aggregate(n.path, lower(hex({})), (h, s) -> sha2(concat(lower(hex(s.left)), h, lower(hex(s.right))), 256)))".format
    append = "aggregate(n.path, {}, (p, s) -> concat(p, s.left, s.right))".format
    done = _recursive(spark, f"""with recursive climb(doc_id, leaf, home, tree, tier, pos, folded, proof) as (
            select doc_id, leaf, tree, up_tree, up_tier, up_pos, {fold("coalesce(n.seen, n.leaf)")}, {append("x''")} from {{leaves}} n
            union all
            select c.doc_id, c.leaf, c.home, n.up_tree, n.up_tier, n.up_pos, {fold("c.folded")}, {append("c.proof")}
            from climb c join {{nodes}} n on c.tree = n.tree and c.tier = n.tier and c.pos = n.pos)
        select doc_id, leaf, home, folded, proof from climb where tree = {END}""", "climb", leaves=leaves, nodes=stored)
    named = subroots.select(F.col("tree").alias("home"), F.lower(F.hex("digest")).alias("subroot"))
    text = lambda c: F.lower(F.hex(c))
    return done.join(named, "home").select("doc_id", text("leaf").alias("leaf"), "subroot", F.lit(root).alias("root"), text("proof").alias("proof"),
                                           text("folded").alias("folded_root"), (text("folded") == root).alias("verified"))
