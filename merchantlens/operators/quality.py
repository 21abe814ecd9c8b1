"""Data-quality checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from merchantlens.operators import skew


ROW_COUNTS = T.StructType(
    [T.StructField("table_name", T.StringType()), T.StructField("row_count", T.LongType())]
)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counts = [
        df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("row_count"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def orphans(txns: DataFrame, merchants: DataFrame) -> DataFrame:
    """Transactions whose merchant is unknown or missing.

    These are the rows the inner join of the KPIs leaves out.  Merchants are counted
    first; one with a large share of all rows is broadcast, and rows without a merchant
    are told without a join (``skew.lookup``).
    """
    known = merchants.select("merchant_id").distinct().withColumn("known", F.lit(True))
    counted = txns.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"))
    table = counted.where(F.col("merchant_id").isNotNull()).join(known, "merchant_id", "left")
    looked = skew.lookup(txns, table, "merchant_id", light=F.col("known").isNull())
    unknown = F.col("found").isNotNull() & F.col("found.known").isNull()
    return looked.where(F.col("merchant_id").isNull() | unknown).select(*txns.columns)


def orphan_merchants(txns: DataFrame, merchants: DataFrame) -> DataFrame:
    """C3 by merchant: counted before the join, so a hot merchant is one row."""
    counted = txns.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("row_count"))
    return counted.join(merchants.select("merchant_id"), "merchant_id", "left_anti")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """C4: key values that occur more than once."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return counted.where(F.col("row_count") > 1)


def null_rates(df: DataFrame) -> DataFrame:
    """K7: nulls of every column in one pass, one output row per column."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    rows = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count"))
                for c in df.columns
            ]
        )
    )
    return (
        counted.select("_rows", rows.alias("r"))
        .select("r.column_name", F.col("_rows").alias("row_count"), "r.null_count")
        .withColumn(
            "null_rate",
            F.try_divide(F.col("null_count").cast("double"), F.col("row_count").cast("double")),
        )
    )
