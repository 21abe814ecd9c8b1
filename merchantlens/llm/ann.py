"""Operator 4, approximate nearest neighbours: multi-index hashing.

Vectors get binary codes: signs after centring, principal axes and a rotation
learned on a sample (iterative quantisation), at most ``SAMPLE_ROWS`` vectors by
hash of the id.  In each shard a code is split into substrings of eight bits, each
indexed by value.  A code within Hamming radius r of a query agrees with it to
within floor(r / m) bits in one of m substrings (and within one bit less in all but
the first r mod m + 1 of them), so probing these buckets retrieves every such
code.  Their vectors are then ranked by Euclidean distance in double precision.

The radius is learned too: the sample's true neighbours lie within it with the
share ``aim``.  Larger data have nearer neighbours, so the share does not fall.  A
query that finds fewer than k in a shard widens its radius there, so nobody gets
fewer than k while there are candidates.  Every vector is indexed.

Rows: see ``vectors.usable``; zero vectors take no part either.  A query only
meets vectors of its own length; lengths too rare in the sample for a model
are compared without codes.  Ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.llm import vectors
from merchantlens.session import cut_lineage

SAMPLE_ROWS = 10_000
LEAST_SAMPLE = 64
BITS = 64
AIM = 0.97
_ONES = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)
_BY_ONES = [np.flatnonzero(_ONES <= most).astype(np.uint8) for most in range(9)]


@dataclass
class Codes:
    """Centre and rotated axes; radius of the search."""

    centre: np.ndarray
    axes: np.ndarray
    radius: int = 0

    def of(self, points: np.ndarray) -> np.ndarray:
        return np.packbits((points - self.centre) @ self.axes > 0, axis=1)


def learn(sample: np.ndarray, k: int, bits: int = BITS, aim: float = AIM, rounds: int = 30) -> Codes:
    """Codes of ``bits`` bits (no more than components) and their radius."""
    bits = min(bits, sample.shape[1])
    centre = sample.mean(axis=0)
    spread = (sample - centre).T @ (sample - centre)  # a square of the vectors' length
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :bits]
    turned = (sample - centre) @ axes
    rng = np.random.default_rng(0)
    rotation = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(turned @ rotation > 0, 1.0, -1.0).T @ turned)
        rotation = (left @ right).T
    codes = Codes(centre, axes @ rotation)
    code, away = codes.of(sample), []
    squares = (sample**2).sum(axis=1)
    for row in range(0, len(sample), max(1, len(sample) // 256)):
        near = squares - 2 * sample @ sample[row]
        near[row] = np.inf
        nearest = np.argpartition(near, min(k, len(near) - 1))[:k]
        away.append(_ONES[code[nearest] ^ code[row]].sum(axis=1))
    codes.radius = int(np.quantile(np.concatenate(away), aim, method="higher"))
    return codes


class SubstringIndex:
    """For each byte of the codes, the rows by value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.rows = [np.argsort(codes[:, m], kind="stable") for m in range(codes.shape[1])]
        values = np.arange(257)
        self.starts = [
            np.searchsorted(codes[rows, m], values) for m, rows in enumerate(self.rows)
        ]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """All rows whose code is within ``radius`` bits of ``code``."""
        parts = len(self.rows)
        hit = np.zeros(len(self.codes), dtype=bool)
        for m in range(parts):
            most = radius // parts - (m > radius % parts)
            if most < 0:
                continue
            values = (code[m] ^ _BY_ONES[min(most, 8)]).astype(np.int64)
            start, end = self.starts[m][values], self.starts[m][values + 1]
            sizes = end - start
            at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            hit[self.rows[m][at]] = True
        rows = np.flatnonzero(hit)
        return rows[_ONES[self.codes[rows] ^ code].sum(axis=1, dtype=np.int64) <= radius]


def search(mine: pd.DataFrame, asked: pd.DataFrame, k: int, models: dict[int, Codes]) -> pd.DataFrame:
    """The k nearest found in one shard for each query."""
    points, q = vectors.matrix(mine["vec"]), vectors.matrix(asked["vec"])
    ids, own = mine["id"].to_numpy(), asked["id"].to_numpy()
    codes = models.get(points.shape[1])
    index = SubstringIndex(codes.of(points)) if codes else None
    coded = codes.of(q) if codes else None
    out = []
    for n in range(len(q)):
        rows = np.arange(len(points))
        if index:
            radius, most = codes.radius, 8 * coded.shape[1]
            rows = index.within(coded[n], radius)
            while len(rows) <= k and radius < most:
                radius = min(most, radius + coded.shape[1])
                rows = index.within(coded[n], radius)
        rows = rows[ids[rows] != own[n]]
        with np.errstate(over="ignore"):
            away = np.sqrt(((points[rows] - q[n]) ** 2).sum(axis=1))
        first = np.lexsort((ids[rows], away))[:k]
        out.append((np.full(len(first), own[n]), ids[rows][first], away[first]))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def fit(found: DataFrame, rows: int, k: int, sample_rows: int = SAMPLE_ROWS) -> dict[int, Codes]:
    """A model for each vector length that the sample has often enough."""
    share = min(1.0, 0.95 * sample_rows / max(1, rows))
    chosen = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1_000_000)) < int(1_000_000 * share)
    sample = found.where(chosen).select("id", "vec").limit(sample_rows).toPandas()
    models = {}
    for dim, of_dim in sample.groupby(sample["vec"].map(len)):
        if len(of_dim) >= LEAST_SAMPLE:
            models[int(dim)] = learn(vectors.matrix(of_dim.sort_values("id")["vec"]), k)
    return models


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 10,
    key: str = "vec_id",
    vec: str = "embedding",
    shard_rows: int = vectors.SHARD_ROWS,
    block_rows: int = vectors.BLOCK_ROWS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k nearest found.

    ``is_query`` is a condition on the column ``id``.
    """
    usable = vectors.usable(df, key, vec, lambda x: x)
    fine = cut_lineage(usable.where(F.exists("vec", lambda x: x != 0)))
    queries = fine.where(is_query)
    kept = cut_lineage(vectors.first_of_equals(fine, k + 1))
    rows = kept.count()
    shards, blocks = vectors.parts(rows, shard_rows), vectors.parts(queries.count(), block_rows)
    models = fit(kept, rows, k)

    def run(mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return search(mine, asked, k, models)

    found = vectors.cells(vectors.with_shard(kept, shards), queries, shards, blocks, run)
    return vectors.best(found, k, nearest_first=True)
