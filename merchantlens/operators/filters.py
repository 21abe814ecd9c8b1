"""Date, category and merchant filters and the lists they choose from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.functions.dates import (
    Period,
    day_literal,
    month_start,
    timestamp_literal,
)


@dataclass(frozen=True)
class Filters:
    """A selection; ``None`` means all."""

    period: Period
    category: str | None = None
    merchant: str | None = None

    @property
    def some_merchants(self) -> bool:
        """Whether this selection may leave merchants out."""
        return self.category is not None or self.merchant is not None

    def chosen(self, merchants: DataFrame) -> DataFrame:
        """The merchants of this selection; merchants go by name."""
        if self.category is not None:
            merchants = merchants.where(F.col("business_category") == self.category)
        if self.merchant is not None:
            merchants = merchants.where(F.col("merchant_name") == self.merchant)
        return merchants


def in_period(day: Column, period: Period) -> Column:
    return day.between(day_literal(period.start), day_literal(period.end))


def date_range(df: DataFrame, period: Period) -> DataFrame:
    """B2: both end days included; prunes month folders where there are any."""
    kept = df.where(in_period(F.col("agg_date"), period))
    if "agg_month" in df.columns:
        kept = kept.where(_months(F.col("agg_month"), period))
    return kept


def ts_range(txns: DataFrame, period: Period, include_end: bool = False) -> DataFrame:
    """From midnight of the first day to midnight of the last.

    ``include_end`` keeps the last day as well.
    """
    at = F.col("transaction_date")
    last = timestamp_literal(period.end)
    if include_end:
        last = F.date_add(day_literal(period.end), 1).cast("timestamp_ntz")
    kept = txns.where((at >= timestamp_literal(period.start)) & (at < last))
    if "txn_month" in txns.columns:
        kept = kept.where(_months(F.col("txn_month"), period))
    return kept


def _months(month: Column, period: Period) -> Column:
    return month.between(
        month_start(day_literal(period.start)), month_start(day_literal(period.end))
    )


def categories(merchants: DataFrame) -> DataFrame:
    """B5"""
    return merchants.select("business_category").distinct().orderBy("business_category")


def merchant_names(merchants: DataFrame) -> DataFrame:
    """Ordered, repeated names kept."""
    return merchants.select("merchant_name").orderBy("merchant_name")


def merchants_of(merchants: DataFrame, category: str) -> DataFrame:
    """B7"""
    return merchants.where(F.col("business_category") == category).select("merchant_name")
