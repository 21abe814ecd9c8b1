"""Operator 10, exact top-k search by inner product: a ball tree in each shard.

A shard's vectors are split again and again at the middle of the direction in
which they are widest.  Every node has a centre c and a radius r, so no vector
below it has an inner product with q above ``q.c + |q| r``.  A query visits the
leaves in the order of this bound (with those of the leaf's ancestors) and ends
where the bound is below its kth score so far.

The kth score is shared: all queries first search one shard each, and what they
find there bounds their search of the other shards.

Components are whole numbers, as ``component`` makes them.  Scores are exact:
sums below 2**53 are added as doubles, larger ones as Python integers, and a
score beyond 64 bits becomes the nearest 64-bit number.

Rows: see ``vectors.usable``.  A query only meets vectors of its own length.
Fewer candidates than k give fewer rows; no usable vector gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.llm import vectors
from merchantlens.session import cut_lineage

LEAF_ROWS = 64
SCHEMA = "query_id long, vec_id long, score long"
_LARGEST = 2**63 - 1


class BallTree:
    """Nodes in arrays; ``order`` holds the rows, each node a range of it."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(points))
        self.centre, self.radius, self.parent, self.leaves = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            start, end, parent = todo.pop()
            rows = self.order[start:end]
            centre = points[rows].mean(axis=0)
            apart = points[rows] - centre
            self.centre.append(centre)
            self.radius.append(np.sqrt((apart**2).sum(axis=1).max()))
            self.parent.append(parent)
            node = len(self.parent) - 1
            if end - start <= leaf_rows or self.radius[-1] == 0:
                self.leaves.append((node, start, end))
                continue
            far = apart[np.argmax((apart**2).sum(axis=1))]
            other = apart[np.argmax(((apart - far) ** 2).sum(axis=1))]
            middle = (end - start) // 2
            self.order[start:end] = rows[np.argpartition(apart @ (far - other), middle)]
            todo += [(start, start + middle, node), (start + middle, end, node)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def bounds(self, asked: np.ndarray) -> np.ndarray:
        """The upper bound of each leaf for each query, a little widened for rounding."""
        length = np.sqrt((asked**2).sum(axis=1))[:, None]
        bound = asked @ self.centre.T + length * self.radius
        bound += 1e-9 * (1 + np.abs(bound) + length * (self.radius + np.sqrt((self.centre**2).sum(axis=1))))
        for node, parent in enumerate(self.parent):  # parents come first
            if parent >= 0:
                np.minimum(bound[:, node], bound[:, parent], out=bound[:, node])
        return bound[:, [node for node, _, _ in self.leaves]]


def _products(asked: np.ndarray, points: np.ndarray, exact: np.ndarray | None) -> np.ndarray:
    if exact is None:
        return asked @ points.T
    return (exact[0] @ exact[1].T).astype(object)


def search(mine: pd.DataFrame, asked: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of ``mine`` for each query, without those below the query's ``bound``."""
    points, q = vectors.matrix(mine["vec"]), vectors.matrix(asked["vec"])
    ids, own = mine["id"].to_numpy(), asked["id"].to_numpy()
    largest = float(np.abs(points).max()) * float(np.abs(q).max()) * points.shape[1]
    whole = None
    if largest >= 2**53:
        whole = vectors.matrix(mine["vec"], object), vectors.matrix(asked["vec"], object)
    kind = np.float64 if whole is None else object
    known = [-np.inf if pd.isna(b) else b for b in asked["bound"]]
    shared = np.array(known, dtype=kind)
    kth = shared.copy()
    scores = np.full((len(q), k), -np.inf, dtype=kind)
    found = np.full((len(q), k), -1, dtype=np.int64)

    tree = BallTree(points)
    bound = tree.bounds(q)
    visits = np.argsort(-bound, axis=1, kind="stable")
    for place in range(len(tree.leaves)):
        leaf_of = visits[:, place]
        least = kth.astype(np.float64)
        least -= 1e-12 * np.abs(least) + 1e-9
        open_ = np.flatnonzero(bound[np.arange(len(q)), leaf_of] >= least)
        if not len(open_):
            break
        for leaf in np.unique(leaf_of[open_]):
            at = open_[leaf_of[open_] == leaf]
            rows = tree.order[tree.leaves[leaf][1] : tree.leaves[leaf][2]]
            exact = None if whole is None else (whole[1][at], whole[0][rows])
            got = _products(q[at], points[rows], exact)
            got = np.where(own[at][:, None] == ids[rows][None, :], -np.inf, got)
            better = (got >= kth[at][:, None]).any(axis=1)
            if not better.any():
                continue
            at, got = at[better], got[better]
            all_scores = np.concatenate([scores[at], got], axis=1)
            all_ids = np.concatenate([found[at], np.broadcast_to(ids[rows], got.shape)], axis=1)
            first = np.lexsort((all_ids, -all_scores), axis=1)[:, :k]
            scores[at] = np.take_along_axis(all_scores, first, axis=1)
            found[at] = np.take_along_axis(all_ids, first, axis=1)
            kth[at] = np.maximum(kth[at], scores[at, k - 1])
    keep = (scores > -np.inf) & (scores >= shared[:, None])
    row, col = np.nonzero(keep.astype(bool))
    values = [max(-_LARGEST - 1, min(_LARGEST, int(s))) for s in scores[row, col]]
    return pd.DataFrame(
        {"query_id": own[row], "vec_id": found[row, col], "score": pd.Series(values, dtype="int64")}
    )


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vec: str = "embedding",
    component=lambda x: F.floor(x * 64),
    shard_rows: int = vectors.SHARD_ROWS,
    block_rows: int = vectors.BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k largest inner products.

    ``is_query`` is a condition on the column ``id``.  Ties go to the smaller id.
    """
    fine = cut_lineage(vectors.usable(df, key, vec, component))
    queries = fine.where(is_query)
    kept = cut_lineage(vectors.first_of_equals(fine, k + 1))
    shards = vectors.parts(kept.count(), shard_rows)
    blocks = vectors.parts(queries.count(), block_rows)
    kept = vectors.with_shard(kept, shards)

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return search(mine, asked, k)

    home = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(shards)).cast("int")
    asked = queries.withColumns({"home": home, "bound": F.lit(None).cast("long")})
    first = asked.withColumn("shards", F.array("home")).drop("home")
    first = cut_lineage(vectors.cells(kept, first, shards, blocks, run, SCHEMA))
    ranked = vectors.best(first, k, nearest_first=False)
    shared = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    second = asked.drop("bound").join(shared.withColumnRenamed("score", "bound"), "id", "left")
    second = second.withColumn("shards", others).drop("home")
    rest = vectors.cells(kept, second, shards, blocks, run, SCHEMA)
    return vectors.best(first.unionAll(rest), k, nearest_first=False)
