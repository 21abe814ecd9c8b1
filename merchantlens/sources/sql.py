"""Questions asked in SQL with named parameters.

Values are bound, never written into the text, so a name with a quote is a name like any
other.  Tables are named in the text as ``{daily}`` and passed as frames: nothing is
registered in the session, and the planner sees through to the scans.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from merchantlens.operators.filters import Filters

#: The rows of a selection; without a category or merchant the parameter is NULL.
_SELECTED = """FROM {daily} d JOIN {merchants} m ON d.merchant_id = m.merchant_id
WHERE d.agg_date BETWEEN :start AND :end
  AND (:category IS NULL OR m.business_category = :category)
  AND (:merchant IS NULL OR m.merchant_name = :merchant)"""

HEADLINE = f"""SELECT CAST(sum(CAST(d.net_revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_rev,
  sum(d.total_transactions) AS total_txns,
  try_divide(100D * sum(d.successful_transactions), CAST(sum(d.total_transactions) AS DOUBLE)) AS success_rate,
  try_divide(100D * sum(d.refunded_transactions), CAST(sum(d.total_transactions) AS DOUBLE)) AS refund_rate,
  sum(d.net_revenue) IS NOT NULL AS has_data
{_SELECTED}"""

SERIES = f"""SELECT d.agg_date, CAST(sum(CAST(d.net_revenue AS DECIMAL(18,2))) AS DOUBLE) AS net_rev
{_SELECTED} GROUP BY d.agg_date"""


def ask(text: str, parameters: Mapping[str, Any], **tables: DataFrame) -> DataFrame:
    """The rows of a query over some frames; ``:name`` in the text is bound to a parameter."""
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(text, args=dict(parameters), **tables)


def selected(text: str, daily: DataFrame, merchants: DataFrame, chosen: Filters) -> DataFrame:
    """``HEADLINE`` or ``SERIES`` of a selection."""
    parameters = {
        "start": chosen.period.start,
        "end": chosen.period.end,
        "category": chosen.category,
        "merchant": chosen.merchant,
    }
    return ask(text, parameters, daily=daily, merchants=merchants)
