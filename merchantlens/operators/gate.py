"""The constraints of the data model at load (C3, C4): rows are accepted or rejected with a reason.

A row is rejected if its key is missing, if its parent is missing or unknown, or if its key
is repeated.  Of the rows that share a key and have no other fault one is accepted: the
smallest by its columns in order, nulls first.  Which one stays therefore does not depend
on files, partitions or retries.

Only keys are shuffled to find the faults, and they are counted where they are first; rows
are then looked up among the faulty keys (``skew.lookup``), which the planner broadcasts if
they are few and which are split where one holds a large share of all rows.  The faulty keys
and the rows that share a key are written, so that neither is found twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantlens.operators import skew
from merchantlens.session import cut_lineage

MISSING_KEY = "missing_key"
MISSING_PARENT = "missing_parent"
UNKNOWN_PARENT = "unknown_parent"
REPEATED_KEY = "repeated_key"
STORED_KEY = "stored_key"


def _counted(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _with_reason(rows: DataFrame, key: str, parent: str | None, parents: DataFrame | None) -> DataFrame:
    """``rows`` with the ``reason`` that needs no other row of the table; NULL without one."""
    reason = F.when(F.col(key).isNull(), F.lit(MISSING_KEY))
    if parent is None:
        return rows.withColumn("reason", reason)
    reason = reason.when(F.col(parent).isNull(), F.lit(MISSING_PARENT))
    known = parents.select(parent).distinct().withColumn("known", F.lit(True))
    table = _counted(rows.where(F.col(parent).isNotNull()), parent).join(known, parent, "left")
    found = skew.lookup(rows, cut_lineage(table), parent, light=F.col("known").isNull())
    unknown = F.col("found").isNotNull() & F.col("found.known").isNull()
    return found.withColumn("reason", reason.when(unknown, F.lit(UNKNOWN_PARENT))).drop("found")


def gate(
    rows: DataFrame,
    key: str,
    parent: str | None = None,
    parents: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): the rows that keep the constraints and those that do not.

    ``parents`` has the keys that ``parent`` may refer to, ``stored`` the keys that are in the
    table already.  Accepted rows have the columns of ``rows``; rejected ones also ``reason``
    and ``copies``, the number of equal rows.
    """
    columns = rows.columns
    whole = F.struct(*columns)
    judged = _with_reason(rows, key, parent, parents)
    fine = judged.where(F.col("reason").isNull()).select(*columns)
    table = _counted(fine, key)
    if stored is not None:
        known = stored.select(key).distinct().withColumn("stored", F.lit(True))
        table = table.join(known, key, "left")
    else:
        table = table.withColumn("stored", F.lit(None).cast("boolean"))
    faulty = (F.col("n") > 1) | F.col("stored").isNotNull()
    looked = skew.lookup(fine, cut_lineage(table.where(faulty)), key)
    single = looked.where(F.col("found").isNull()).select(*columns)
    shared = cut_lineage(looked.where(F.col("found").isNotNull()))
    kept = shared.groupBy(key).agg(
        F.min(whole).alias("kept"), F.count(F.lit(1)).alias("n"), F.any_value("found.stored").alias("stored")
    )
    accepted = single.unionByName(kept.where(F.col("stored").isNull()).select("kept.*"))

    copies = F.count(F.lit(1)).alias("copies")
    first = judged.where(F.col("reason").isNotNull()).groupBy(*columns, "reason").agg(copies)
    compared = skew.lookup(shared.groupBy(*columns).agg(copies), kept, key)
    is_kept = whole.eqNullSafe(F.col("found.kept")) & F.col("found.stored").isNull()
    reason = F.when(F.col("found.stored").isNotNull(), F.lit(STORED_KEY)).otherwise(F.lit(REPEATED_KEY))
    repeated = compared.select(
        *columns, reason.alias("reason"), (F.col("copies") - is_kept.cast("long")).alias("copies")
    ).where(F.col("copies") > 0)
    return accepted, first.unionByName(repeated)
