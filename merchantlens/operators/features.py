"""Daily series and their features.

A series is ``series_key``, ``agg_date`` and ``net_revenue``, one row per day.
Windows always partition by the series; a partition holds one row per calendar
day and so is bounded by the span of the data, whatever its number of
transactions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from merchantlens.functions import dates, rules
from merchantlens.functions.dates import Period
from merchantlens.operators import kpis

TARGET = "net_revenue"
CALENDAR = ["day_of_week", "day_of_month", "month", "is_weekend"]
FEATURES = (
    CALENDAR
    + [f"revenue_lag_{k}" for k in rules.LAGS]
    + [f"rolling_avg_{n}d" for n in rules.ROLLING]
)

PLATFORM, CATEGORY, MERCHANT = "Platform", "Category", "Merchant"


def daily_series(
    frame: DataFrame, level: str = PLATFORM, merchants: DataFrame | None = None
) -> DataFrame:
    """Net revenue by day for the platform, each category or each merchant."""
    if level == PLATFORM:
        sums = frame.groupBy(F.lit(PLATFORM).alias("series_key"), "agg_date")
        value = kpis.total(frame, TARGET)
    elif level == CATEGORY:
        joined = kpis.with_merchant(frame, merchants, "business_category", keys=["agg_date"])
        sums = joined.groupBy(F.col("business_category").alias("series_key"), "agg_date")
        value = kpis.total(joined, TARGET)
    elif level == MERCHANT:
        sums = frame.groupBy(F.col("merchant_id").cast("string").alias("series_key"), "agg_date")
        value = kpis.total(frame, TARGET)
    else:
        raise ValueError(f"unknown level {level!r}")
    return sums.agg(value.cast("double").alias(TARGET))


def date_spine(
    series: DataFrame, period: Period | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """K5: every series on every day, missing days filled with 0.

    ``keys`` (series_key) names the series; without it they are those with a
    row in the period.

    Without a period the days run over the span of the whole data.  Each row
    stretches over the gap up to the next one, and the first also over the gap
    before it, so one window does it: no spine to join with, and windows that
    follow find the rows partitioned by series already.
    """
    if period is None:
        # Counting the target keeps the subquery's shuffle equal to that of the
        # rows themselves, so that it is reused.
        span = series.agg(
            F.struct(
                F.min("agg_date").alias("first"),
                F.max("agg_date").alias("last"),
                F.count(TARGET).alias("n"),
            ).alias("s")
        ).scalar()
        first, last = span.getField("first"), span.getField("last")
    else:
        first, last = dates.day_literal(period.start), dates.day_literal(period.end)
        series = series.where(F.col("agg_date").between(first, last))
    if keys is not None:
        series = keys.select("series_key").distinct().join(series, "series_key", "left")
    day = F.col("agg_date")
    start = F.when(F.lag(day).over(by_series()).isNull(), first).otherwise(day)
    end = F.coalesce(F.date_sub(F.lead(day).over(by_series()), 1), last)
    stretched = series.withColumns({"_start": start, "_end": end}).select(
        "series_key",
        F.col("agg_date").alias("_day"),
        TARGET,
        F.explode(F.sequence("_start", "_end")).alias("agg_date"),
    )
    own = F.col("agg_date") == F.col("_day")
    value = F.coalesce(F.when(own, F.col(TARGET)), F.lit(0.0))
    return stretched.select("series_key", "agg_date", value.alias(TARGET))


def calendar(day: Column) -> dict[str, Column]:
    return {
        "day_of_week": dates.day_of_week(day),
        "day_of_month": F.dayofmonth(day),
        "month": F.month(day),
        "is_weekend": dates.is_weekend(day),
    }


def by_series() -> WindowSpec:
    return Window.partitionBy("series_key").orderBy("agg_date")


def lags(series: DataFrame) -> DataFrame:
    """Earlier values by row, not by calendar day."""
    return series.withColumns(
        {f"revenue_lag_{k}": F.lag(TARGET, k).over(by_series()) for k in rules.LAGS}
    )


def preceding_mean(value: str, rows: int) -> Column:
    """Mean of the preceding rows; NULL until all of them are there."""
    frame = by_series().rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) == rows, F.avg(value).over(frame))


def rolling_means(series: DataFrame) -> DataFrame:
    """E2"""
    return series.withColumns(
        {f"rolling_avg_{n}d": preceding_mean(TARGET, n) for n in rules.ROLLING}
    )


def build(series: DataFrame) -> DataFrame:
    """The training frame; rows with any gap are dropped."""
    framed = rolling_means(lags(series)).withColumns(calendar(F.col("agg_date")))
    return framed.na.drop("any").select("series_key", "agg_date", TARGET, *FEATURES)
