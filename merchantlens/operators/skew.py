"""Joins that a key with a large share of all rows cannot skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Keys that hold more than one in so many rows are broadcast; there are at most as many.
HEAVY = 10_000
#: Parts over which the rows of such keys are spread.
SALTS = 1 << 10


def lookup(
    rows: DataFrame, table: DataFrame, on: str, weight: str = "n", light: Column | None = None, heavy: int = HEAVY
) -> DataFrame:
    """``rows`` with ``found``: the other columns of its key's row in ``table``, or NULL.

    ``table`` has one row a key, with the number of ``rows`` that hold it in ``weight``; every
    key that may be held by many must be in it.  The heavy ones are broadcast, and their rows
    are spread over the parts of the join with the others.  ``light`` says which of the
    others are wanted.  Rows with a null key find nothing and are spread as well.
    """
    least = table.agg((F.sum(weight) / heavy).alias("least")).scalar()
    value = F.struct(*[name for name in table.columns if name != on])
    hot = table.where(F.col(weight) > least).select(F.col(on), value.alias("_hot"))
    others = table.where((F.col(weight) <= least) & (F.lit(True) if light is None else light))
    others = others.select(F.col(on), F.lit(0).alias("_salt"), value.alias("_other"))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int") + 1
    alone = F.col("_hot").isNotNull() | F.col(on).isNull()
    salted = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(alone, spread).otherwise(0))
    joined = salted.join(others, [on, "_salt"], "left")
    return joined.select(*rows.columns, F.coalesce("_hot", "_other").alias("found"))
