"""Exact inner-product search with two cover trees.

Queries and data are cut into chunks, and each chunk becomes a cover tree: the
children of a node of radius r are centres more than r / BASE apart that cover
all its points within that distance.  For every pair of a query chunk and a data
chunk both trees are walked together.  A pair of nodes is pruned when
    <q, p> + |q| r_p + |p| r_q + r_q r_p
(centres q, p and covering radii r) is below the worst kth score of the query node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackpool.llm.common import task_number
from stackpool.llm.vectors import keyed, matrices
from stackpool.session import materialise

BASE = 1.3
#: Points of a node that is not divided further, and of a chunk.
LEAF, CHUNK = 16, 2048
_EXACT = float(1 << 53)


class CoverTree:
    """Cover tree over the rows of a matrix; points of a node stand together.

    ``order`` lists the rows by place; node i has ``centre[i]`` (a place),
    ``radius[i]``, places ``begin[i]:end[i]`` and children ``first[i]:last[i]``.
    """

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        square = (points * points).sum(axis=1)
        gaps = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * points @ points.T, 0.0))
        # the root's centre is the point nearest the mean
        root = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        rows = np.concatenate([[root], np.delete(np.arange(len(points)), root)])
        centre, radius, begin, end, first, last = [root], [float(gaps[root].max())], [0], [len(points)], [0], [0]
        self.order[:] = rows
        todo = [0]
        while todo:
            i = todo.pop()
            own = self.order[begin[i]:end[i]].copy()
            if len(own) <= LEAF or radius[i] == 0:
                continue
            net, owner = self._net(gaps[np.ix_(own, own)], radius[i] / BASE)
            self.order[begin[i]:end[i]] = own[np.argsort(owner, kind="stable")]
            at, first[i] = begin[i], len(centre)
            for c, many in zip(net, np.bincount(owner, minlength=len(net))):
                centre.append(int(own[c]))
                begin.append(at)
                at += int(many)
                end.append(at)
                radius.append(float(gaps[own[c], self.order[begin[-1]:at]].max()))
                first.append(0)
                last.append(0)
                if many > LEAF:
                    todo.append(len(centre) - 1)
            last[i] = len(centre)
        self.points = points[self.order]
        self.centres = points[centre]
        self.norm = np.sqrt((self.centres * self.centres).sum(axis=1))
        # rounding of the distances must not make a radius too small
        self.radius = np.array(radius) * (1 + 1e-9) + 1e-6
        self.radius[np.array(radius) == 0] = 0.0
        self.begin, self.end, self.first, self.last = (np.array(x) for x in (begin, end, first, last))

    @staticmethod
    def _net(gaps: np.ndarray, apart: float) -> tuple[list[int], np.ndarray]:
        """Centres by farthest-first choice until all points lie within ``apart`` of one; the nearest centre of each point."""
        near, owner, net = gaps[0].copy(), np.zeros(len(gaps), dtype=np.int64), [0]
        while near[far := int(near.argmax())] > apart:
            closer = gaps[far] < near
            near[closer], owner[closer] = gaps[far][closer], len(net)
            net.append(far)
        return net, owner


class _Best:
    """The k best of each query so far, by score, then by smaller id."""

    def __init__(self, queries: int, k: int, repeats: bool = False):
        self.k = k
        # whether an id may come more than once: it then counts with its best score alone
        self.repeats = repeats
        self.scores = [np.zeros(0)] * queries
        self.ids = [np.zeros(0, dtype=np.int64)] * queries
        self.worst = np.full(queries, -np.inf)

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > self.k and not self.repeats:
            keep = scores >= max(self.worst[q], np.partition(scores, -self.k)[-self.k])
        else:
            keep = scores >= self.worst[q]
        scores, ids = np.concatenate([self.scores[q], scores[keep]]), np.concatenate([self.ids[q], ids[keep]])
        best = np.lexsort((ids, -scores))
        if self.repeats:
            best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
        best = best[:self.k]
        self.scores[q], self.ids[q] = scores[best], ids[best]
        if len(best) == self.k:
            self.worst[q] = scores[best[-1]]


def search(queries: CoverTree, query_ids: np.ndarray, data: CoverTree, data_ids: np.ndarray, k: int):
    """Rows (query id, vec id, score) of the k best of each query among the data; ids are given by place."""
    best = _Best(len(query_ids), k, len(np.unique(data_ids)) < len(data_ids))

    def compare(q: int, nodes: np.ndarray) -> None:
        """Meet a query node with data nodes: prune, then divide the data, then the queries."""
        a, b = queries.begin[q], queries.end[q]
        done = []
        while len(nodes):
            bound = (data.centres[nodes] @ queries.centres[q] + queries.norm[q] * data.radius[nodes]
                     + data.norm[nodes] * queries.radius[q] + data.radius[nodes] * queries.radius[q])
            nodes = nodes[bound + 1e-9 * np.abs(bound) >= best.worst[a:b].min()]
            leaf = data.first[nodes] == data.last[nodes]
            done.append(nodes[leaf])
            nodes = nodes[~leaf]
            if len(nodes):
                nodes = np.concatenate([np.arange(data.first[n], data.last[n]) for n in nodes])
        leaves = np.concatenate(done) if done else nodes
        if not len(leaves):
            return
        if queries.first[q] < queries.last[q]:
            for child in range(queries.first[q], queries.last[q]):
                compare(child, leaves)
            return
        many = data.end[leaves] - data.begin[leaves]
        places = np.repeat(data.begin[leaves] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        ids = data_ids[places]
        for i, scores in zip(range(a, b), queries.points[a:b] @ data.points[places].T):
            other = ids != query_ids[i]
            best.add(i, scores[other], ids[other])

    compare(0, np.zeros(1, dtype=np.int64))
    return [(int(query_ids[i]), int(v), int(s)) for i in range(len(query_ids)) for v, s in zip(best.ids[i], best.scores[i])]


def chunks(rows: DataFrame, scale: float, chunk: int) -> DataFrame:
    """(dim, chunk, ids, points): up to ``chunk`` vectors of one length as whole numbers floor(scale * x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        made, part = 0, task_number()

        def out(d: int, ids: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "chunk": pa.array([(part << 33) + made], pa.int64()),
                                               "ids": [ids.astype("<i8").tobytes()], "points": [points.astype("<f8").tobytes()]})
        for batch in batches:
            for ids, matrix in matrices(batch):
                d = matrix.shape[1]
                whole = np.floor(scale * matrix)
                if (whole * whole).sum(axis=1).max(initial=0.0) >= _EXACT:
                    raise ValueError("components too large for exact scores")
                held = waiting.setdefault(d, [])
                held.append((ids, whole))
                if sum(len(i) for i, _ in held) >= chunk:
                    ids, points = (np.concatenate(x) for x in zip(*held))
                    full = len(ids) // chunk * chunk
                    for a in range(0, full, chunk):
                        yield out(d, ids[a:a + chunk], points[a:a + chunk])
                    waiting[d] = [(ids[full:], points[full:])]
        for d, held in waiting.items():
            ids, points = (np.concatenate(x) for x in zip(*held))
            if len(ids):
                yield out(d, ids, points)
    return rows.mapInArrow(run, "dim int, chunk long, ids binary, points binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
          chunk: int = CHUNK) -> DataFrame:
    """The k rows of greatest inner product of floor(scale * x) for each query row: query_id, rank (from 1), vec_id, score.

    ``queries`` has the columns of ``vectors``; a row is no candidate of a query
    with its own id.  Ties go to the smaller vec_id; a query with fewer candidates
    gets all.  Rows that share an id count as one, with their best score.  Vectors
    that are null, empty or hold null or non-finite components take no part, and
    vectors meet only those of their length.  Squared lengths must stay below
    2^53, where whole numbers are exact in doubles; larger ones raise ValueError.
    """
    data = materialise(chunks(keyed(vectors, id_col, vector_col), scale, chunk), "data-chunks")
    asked = materialise(chunks(keyed(queries, id_col, vector_col).coalesce(max(1, queries.sparkSession.sparkContext.defaultParallelism // 4)), scale, chunk),
                        "query-chunks")
    # a stated query set against all rows, in blocks: one row a pair of chunks, without their vectors
    names = asked.select("dim", F.col("chunk").alias("q_chunk")).join(data.select("dim", "chunk"), "dim")
    sides = (names.join(data.select("chunk", "ids", "points"), "chunk").withColumn("side", F.lit(1))
             .unionByName(names.join(asked.select(F.col("chunk").alias("q_chunk"), "ids", "points"), "q_chunk").withColumn("side", F.lit(0))))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        trees = {}
        for side, dim, ids, points in zip(group.side, group.dim, group.ids, group.points):
            tree = CoverTree(np.frombuffer(points, dtype="<f8").reshape(-1, dim))
            trees[side] = tree, np.frombuffer(ids, dtype="<i8")[tree.order]
        return pd.DataFrame(search(*trees[0], *trees[1], k), columns=["query_id", "vec_id", "score"], dtype="int64")
    found = sides.groupBy("q_chunk", "chunk").applyInPandas(meet, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # k rows at most for each pair of a query and a chunk
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
