"""Breakdowns by category, merchant and payment method."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.functions import numbers, rules
from merchantlens.functions.dates import Period
from merchantlens.operators import filters as flt, kpis
from merchantlens.operators.filters import Filters


def by_category(frame: DataFrame, merchants: DataFrame) -> DataFrame:
    """D3: net revenue by business category, largest first."""
    joined = kpis.with_merchant(frame, merchants, "business_category")
    net = kpis.total(joined, "net_revenue").cast("double")
    return (
        joined.groupBy("business_category")
        .agg(net.alias("total_net_revenue"))
        .orderBy(F.desc_nulls_last("total_net_revenue"), "business_category")
    )


def top_segments(
    frame: DataFrame, merchants: DataFrame, chosen: Filters, limit: int = 10
) -> DataFrame:
    """The largest categories, or merchants once a category is chosen.

    Ties go by name (S26).  The sort with a limit is a distributed top-k.
    """
    segment = "business_category" if chosen.category is None else "merchant_name"
    kept = flt.date_range(frame, chosen.period)
    joined = kpis.with_merchant(kept, merchants, segment, chosen=chosen)
    return (
        joined.groupBy(F.col(segment).alias("segment"))
        .agg(kpis.total(joined, "net_revenue").cast("double").alias("rev"))
        .orderBy(F.desc_nulls_last("rev"), "segment")
        .limit(limit)
    )


def with_shares(df: DataFrame, **shares: str) -> DataFrame:
    """Each ``share=column`` as a percentage of the column's total.

    The totals are a scalar subquery over the same grouped rows.  It sums every
    column the rows carry, so that its shuffle is the very one of the rows and
    is run once.
    """
    sums = F.struct(*[F.sum(c).alias(c) for c in shares.values()])
    totals = df.agg(sums.alias("totals")).scalar()
    return df.withColumns(
        {
            share: numbers.percent(F.col(column), totals.getField(column))
            for share, column in shares.items()
        }
    )


def payment_distribution(txns: DataFrame, drop_null: bool = True) -> DataFrame:
    """Count and amount by payment method, each with its share.

    Rows without a method are left out before the shares are taken (S7).
    """
    if drop_null:
        txns = txns.na.drop(subset=["payment_method"])
    grouped = txns.groupBy("payment_method").agg(
        F.count(F.lit(1)).alias("txn_count"),
        numbers.exact_sum(txns, "transaction_amount").alias("total_amount"),
    )
    shared = with_shares(grouped, count_share="txn_count", amount_share="total_amount")
    return shared.withColumn("total_amount", F.col("total_amount").cast("double"))


def payment_mix(
    txns: DataFrame,
    period: Period,
    include_end: bool = False,
    merchants: DataFrame | None = None,
    chosen: Filters | None = None,
) -> DataFrame:
    """Transactions by payment method in a period, null kept.

    The category and merchant filters do not apply unless ``merchants`` and
    ``chosen`` are given.
    """
    rows = flt.ts_range(txns, period, include_end).select(
        "merchant_id", "payment_method", F.lit(1).cast("long").alias("n")
    )
    count = F.sum("n")
    if merchants is not None and chosen is not None:
        rows = kpis.join_merchants(
            rows,
            chosen.chosen(merchants).select("merchant_id"),
            lambda r: r.groupBy("merchant_id", "payment_method").agg(count.alias("n")),
            chosen.some_merchants,
        )
    mix = rows.groupBy("payment_method").agg(count.alias("txn_count"))
    total = mix.agg(F.sum("txn_count").alias("total")).scalar()
    return mix.withColumn("total_txns", total)


def size_band(
    frame: DataFrame,
    bands: Sequence[tuple[str, float]] = rules.SIZE_BANDS,
    smallest: str = rules.SMALLEST_BAND,
    per_day: bool = True,
) -> DataFrame:
    """K6: merchants classed by observed volume.

    The measure is the mean of the days on which the merchant traded, or the
    whole volume with ``per_day=False``; ``bands`` run from the largest floor.
    """
    days = kpis.rollup_to(frame, "merchant_id", "agg_date")
    volume = days.groupBy("merchant_id").agg(
        F.sum("total_transactions").alias("total_transactions"),
        F.count(F.lit(1)).alias("active_days"),
    )
    mean = F.col("total_transactions").cast("double") / F.col("active_days").cast("double")
    measure = F.col("mean_daily") if per_day else F.col("total_transactions")
    band: Column = F.lit(smallest)
    for name, floor in reversed(bands):
        band = F.when(measure >= floor, F.lit(name)).otherwise(band)
    return volume.withColumn("mean_daily", mean).withColumn("size_band", band)
