"""Watch job: what departs from the usual, and the seasons it is measured against."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from merchantlens.functions import dates
from merchantlens.operators import features, insights, kpis, seasonal, segments


def watch(daily: DataFrame, txns: DataFrame, merchants: DataFrame) -> dict[str, DataFrame]:
    """Refund alerts by month, anomalies of revenue and of payment methods, size bands, seasons."""
    months = daily.withColumn("month", dates.month_start(F.col("agg_date")))
    days = kpis.segment_days(daily, merchants)
    rates = days.withColumnRenamed("business_category", "series_key")
    rates = rates.withColumn("net_revenue", F.col("net_revenue").cast("double"))
    counts = kpis.measures(txns).withColumn("series_key", F.lit(features.PLATFORM))
    return {
        "refund_alerts": insights.refund_alerts(months, "month").orderBy("month"),
        "revenue_anomalies": insights.anomalies(rates).orderBy("series_key", "agg_date"),
        "payment_mix_anomalies": insights.payment_mix_anomalies(counts).orderBy("agg_date"),
        "size_bands": segments.size_band(daily),
        "seasonal_factors": seasonal.factors(seasonal.decompose(days)),
        "category_days": features.date_spine(features.daily_series(daily, features.CATEGORY, merchants)),
    }
