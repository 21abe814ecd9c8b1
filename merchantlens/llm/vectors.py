"""What the two vector searches share: usable vectors, and cells of shards and query blocks.

Vectors are dealt by hash into shards of about ``SHARD_ROWS`` rows, queries into
blocks of about ``BLOCK_ROWS``.  A cell is one shard with one block; cells are
searched by separate tasks, in memory bounded by these two numbers.  Cells give
at most k rows a query; a window whose limit is applied before the shuffle
keeps the k best.

Only the first k + 1 ids of equal vectors can be among the k best of a query, so
the others of a group of copies are left out before anything is searched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

SHARD_ROWS = 8_192
BLOCK_ROWS = 4_096
FOUND = "query_id long, vec_id long, score double"


def usable(df: DataFrame, key: str, vec: str, component: Callable[[Column], Column]) -> DataFrame:
    """``id`` long, ``vec`` and ``dim`` of the rows that can take part.

    Rows whose id or vector is null, whose vector is empty or has a null or
    non-finite component take no part.  Rows equal in id and vector count once;
    different vectors of an id all take part, and as queries share their ranks.
    """
    numbers = F.col(vec).cast("array<double>")
    fine = F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    kept = df.where(F.col(key).isNotNull() & (F.size(vec) > 0) & fine)
    found = kept.select(F.col(key).cast("long").alias("id"), F.transform(numbers, component).alias("vec"))
    return found.dropDuplicates(["id", "vec"]).withColumn("dim", F.size("vec"))


def first_of_equals(vectors: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` smallest ids of each vector."""
    order = Window.partitionBy("vec").orderBy("id")
    ranked = vectors.withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= keep).drop("place")


def cells(
    vectors: DataFrame, queries: DataFrame, shards: int, blocks: int, search, schema: str = FOUND
) -> DataFrame:
    """``search(vectors, queries)``, two pandas frames, over every cell.

    Vectors have ``shard``; each is dealt to every block, each query to every shard.
    """
    cell = ["dim", "shard", "block"]
    block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = vectors.select("id", "vec", "dim", "shard", block)
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    shard = F.explode(F.col("shards") if "shards" in queries.columns else every).alias("shard")
    kept = [c for c in queries.columns if c not in ("block", "shards")]
    dealt = F.pmod(F.xxhash64(F.lit(3), "id", "vec"), F.lit(blocks)).cast("int").alias("block")
    right = queries.select(*kept, dealt, shard)

    def run(key: tuple, mine: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or asked.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return search(mine, asked)

    grouped = left.groupBy(*cell).cogroup(right.groupBy(*cell))
    return grouped.applyInPandas(run, schema)


def with_shard(vectors: DataFrame, shards: int) -> DataFrame:
    return vectors.withColumn("shard", F.pmod(F.xxhash64("id", "vec"), F.lit(shards)).cast("int"))


def parts(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def matrix(column: pd.Series, dtype=np.float64) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=dtype) for v in column])


def best(found: DataFrame, k: int, nearest_first: bool) -> DataFrame:
    """The k best of each query with their ``rank``, ties to the smaller id."""
    score = F.col("score").asc() if nearest_first else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(score, F.col("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
