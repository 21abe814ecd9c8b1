"""Exploration job: the four tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from merchantlens.operators import kpis, segments


def explore(daily: DataFrame, txns: DataFrame, merchants: DataFrame) -> dict[str, DataFrame]:
    """Each table comes in the order in which it is drawn."""
    return {
        "platform_revenue_trend": kpis.platform_trend(daily).orderBy("agg_date"),
        "revenue_by_category": segments.by_category(daily, merchants),
        "payment_methods": segments.payment_distribution(txns).orderBy("payment_method"),
        "transaction_rates": kpis.daily_rates(daily).orderBy("agg_date"),
    }
