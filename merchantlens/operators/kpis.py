"""KPI tables.

All operators read a *measure frame*: ``agg_date``, ``merchant_id`` and the
additive columns below.  ``measures`` gives it one row per transaction and
``daily_kpis`` one row per merchant-day; sums come out the same from either.  A
query over raw transactions therefore need not build the merchant-day table
first, and shuffles only as many rows as its own groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.functions import dates, numbers, rules
from merchantlens.functions.dates import Period
from merchantlens.operators import filters as flt
from merchantlens.operators.filters import Filters
from merchantlens.session import cut_lineage, many_merchants

AMOUNTS = ("gross_revenue", "net_revenue", "processing_fees", "refund_total")
COUNTS = (
    "total_transactions",
    "successful_transactions",
    "failed_transactions",
    "refunded_transactions",
)
RATES = {
    "success_rate": "successful_transactions",
    "failure_rate": "failed_transactions",
    "refund_rate": "refunded_transactions",
}


def measures(txns: DataFrame) -> DataFrame:
    """Transactions as a measure frame: a projection, no shuffle."""
    month = ["txn_month AS agg_month"] if "txn_month" in txns.columns else []
    return txns.selectExpr(
        "CAST(transaction_date AS DATE) AS agg_date",
        "merchant_id",
        "payment_method",
        f"CASE WHEN payment_status = '{rules.SUCCESSFUL}' THEN transaction_amount "
        "ELSE CAST(0 AS DECIMAL(18,2)) END AS gross_revenue",
        "settlement_amount AS net_revenue",
        "1L AS total_transactions",
        f"IF(payment_status = '{rules.SUCCESSFUL}', 1L, 0L) AS successful_transactions",
        f"IF(payment_status = '{rules.FAILED}', 1L, 0L) AS failed_transactions",
        f"IF(payment_status = '{rules.REFUNDED}', 1L, 0L) AS refunded_transactions",
        "processing_fee AS processing_fees",
        "refund_amount AS refund_total",
        *month,
    )


def total(df: DataFrame, name: str) -> Column:
    """Exact sum of one additive column."""
    return numbers.exact_sum(df, name) if name in AMOUNTS else F.sum(name)


def rollup_to(df: DataFrame, *keys: str) -> DataFrame:
    """Sum every additive column by ``keys``; amounts stay DECIMAL.

    Unused sums are pruned by the optimiser, and the partial aggregate runs
    before the shuffle, so a hot key costs one row per task.
    """
    return df.groupBy(*keys).agg(*[total(df, c).alias(c) for c in AMOUNTS + COUNTS])


def daily_kpis(txns: DataFrame) -> DataFrame:
    """The merchant-day table; the average is NULL without a success."""
    sums = rollup_to(measures(txns), "agg_date", "merchant_id")
    average = F.try_divide(
        F.col("gross_revenue").cast("double"), F.col("successful_transactions").cast("double")
    )
    return sums.select(
        "agg_date",
        "merchant_id",
        F.col("gross_revenue").cast("double").alias("gross_revenue"),
        F.col("net_revenue").cast("double").alias("net_revenue"),
        *COUNTS,
        average.alias("avg_transaction_value"),
        F.col("processing_fees").cast("double").alias("processing_fees"),
        F.col("refund_total").cast("double").alias("refund_total"),
    )


def join_merchants(
    rows: DataFrame,
    dimension: DataFrame,
    condense: Callable[[DataFrame], DataFrame],
    some: bool = False,
) -> DataFrame:
    """Inner join of ``rows`` with merchants.

    Merchants that the planner broadcasts meet the rows where they lie, and only
    the caller's own groups are shuffled.  A session with more merchants says so
    (``session.MANY_MERCHANTS``).  ``condense`` then sums the rows by merchant
    first, so that the join gets a bounded number of rows a merchant and a hot
    one cannot skew it.  If ``dimension`` holds ``some`` merchants only, it is
    written out before, so that the planner knows the size of what was chosen, and
    restricts the rows that are summed.  Both ways give the same rows.
    """
    if many_merchants(rows.sparkSession):
        if some:
            dimension = cut_lineage(dimension)
            rows = rows.join(dimension.select("merchant_id"), "merchant_id", "left_semi")
        rows = condense(rows)
    return rows.join(dimension, "merchant_id", "inner")


def with_merchant(
    frame: DataFrame,
    merchants: DataFrame,
    *attributes: str,
    keys: Sequence[str] = (),
    chosen: Filters | None = None,
) -> DataFrame:
    """A measure frame with attributes of the (chosen) merchants, to be summed by ``keys`` and those."""
    some = chosen is not None and chosen.some_merchants
    dimension = (chosen.chosen(merchants) if some else merchants).select("merchant_id", *attributes)
    return join_merchants(frame, dimension, lambda rows: rollup_to(rows, "merchant_id", *keys), some)


def filtered_daily(daily: DataFrame, merchants: DataFrame, chosen: Filters) -> DataFrame:
    """B2 + B4 + C1: merchant-day rows of a selection with merchant attributes."""
    dimension = chosen.chosen(merchants).select(
        "merchant_id", "merchant_name", "business_category", "business_size"
    )
    return flt.date_range(daily, chosen.period).join(dimension, "merchant_id", "inner")


def report_rows(daily: DataFrame, merchants: DataFrame, chosen: Filters) -> DataFrame:
    """The exported report, one row per merchant-day."""
    rows = filtered_daily(daily, merchants, chosen)
    return rows.select("agg_date", "net_revenue", "total_transactions")


def platform_trend(frame: DataFrame) -> DataFrame:
    """Gross revenue and transactions by day."""
    return frame.groupBy("agg_date").agg(
        total(frame, "gross_revenue").cast("double").alias("total_revenue"),
        total(frame, "total_transactions").alias("total_txns"),
    )


def _with_rates(sums: DataFrame) -> DataFrame:
    """Status counts as percentages of all transactions."""
    whole = F.col("total_transactions")
    return sums.withColumns({r: numbers.percent(F.col(c), whole) for r, c in RATES.items()})


def daily_rates(frame: DataFrame) -> DataFrame:
    """Success, failure and refund percentages by day."""
    return _with_rates(rollup_to(frame, "agg_date")).select("agg_date", *RATES)


def segment_days(frame: DataFrame, merchants: DataFrame) -> DataFrame:
    """Category-day sums and rates, the input of alerts and anomaly flags."""
    by_merchant = with_merchant(frame, merchants, "business_category", keys=["agg_date"])
    return _with_rates(rollup_to(by_merchant, "business_category", "agg_date"))


def revenue_series(frame: DataFrame, merchants: DataFrame, chosen: Filters) -> DataFrame:
    """Net revenue by day under a selection."""
    kept = flt.date_range(frame, chosen.period)
    joined = with_merchant(kept, merchants, keys=["agg_date"], chosen=chosen)
    net = total(joined, "net_revenue").cast("double")
    return joined.groupBy("agg_date").agg(net.alias("net_rev"))


def headline(frame: DataFrame, merchants: DataFrame, chosen: Filters) -> DataFrame:
    """One row of totals and rates; all NULL when nothing matches."""
    kept = flt.date_range(frame, chosen.period)
    joined = with_merchant(kept, merchants, chosen=chosen)
    sums = joined.agg(*[total(joined, c).alias(c) for c in ("net_revenue",) + COUNTS])
    return _with_rates(sums).select(
        F.col("net_revenue").cast("double").alias("total_rev"),
        F.col("total_transactions").alias("total_txns"),
        "success_rate",
        "refund_rate",
        F.col("net_revenue").isNotNull().alias("has_data"),
    )


def period_compare(
    frame: DataFrame,
    merchants: DataFrame,
    chosen: Filters,
    overlap: bool = True,
    alert_above: float = rules.ALERT_REFUND_RATE,
) -> DataFrame:
    """This period against the previous one, in a single scan."""
    now, before = chosen.period, chosen.period.previous(overlap)
    kept = flt.date_range(frame, Period(before.start, now.end))
    current = flt.in_period(F.col("agg_date"), now)
    earlier = flt.in_period(F.col("agg_date"), before)
    net = F.col("net_revenue")
    sums = {
        "total_rev": F.when(current, net),
        "prev_rev": F.when(earlier, net),
        "total_txns": F.when(current, F.col("total_transactions")),
        "_successful": F.when(current, F.col("successful_transactions")),
        "_refunded": F.when(current, F.col("refunded_transactions")),
    }
    money = ("total_rev", "prev_rev")

    def summed(rows: DataFrame) -> list[Column]:
        return [
            (numbers.exact_sum(rows, name) if name in money else F.sum(name)).alias(name) for name in sums
        ]

    joined = join_merchants(
        kept.select("merchant_id", *[value.alias(name) for name, value in sums.items()]),
        chosen.chosen(merchants).select("merchant_id"),
        lambda rows: rows.groupBy("merchant_id").agg(*summed(rows)),
        chosen.some_merchants,
    )
    totals = joined.agg(*summed(joined))

    revenue, previous = (F.col(name).cast("double") for name in money)
    no_base = F.col("prev_rev").isNull() | (F.col("prev_rev") == 0)
    trend = F.when(no_base, F.lit(0.0)).otherwise(
        F.try_divide(revenue - previous, previous) * F.lit(100.0)
    )
    has_data = F.col("total_rev").isNotNull()
    refund_rate = numbers.percent(F.col("_refunded"), F.col("total_txns"))
    return totals.select(
        revenue.alias("total_rev"),
        F.when(no_base, revenue).otherwise(previous).alias("prev_rev"),
        F.when(has_data, trend).alias("rev_trend"),
        F.when(has_data, F.when(trend >= 0, "up").otherwise("down")).alias("direction"),
        F.col("total_txns"),
        numbers.percent(F.col("_successful"), F.col("total_txns")).alias("success_rate"),
        refund_rate.alias("refund_rate"),
        F.coalesce(refund_rate > alert_above, F.lit(False)).alias("refund_alert"),
        has_data.alias("has_data"),
        dates.day_literal(before.start).alias("prev_start"),
        dates.day_literal(before.end).alias("prev_end"),
    )


def cards(compared: DataFrame) -> DataFrame:
    """The headline figures as printed on the dashboard."""
    arrow = F.when(F.col("direction") == "up", "▲").otherwise("▼")
    trend = F.concat(arrow, F.lit(" "), numbers.one_decimal(F.abs("rev_trend")), F.lit("%"))
    return compared.where("has_data").select(
        F.concat(F.lit("₹"), numbers.crores(F.col("total_rev")), F.lit(" Cr")).alias("earnings"),
        trend.alias("trend"),
        numbers.thousands(F.col("total_txns")).alias("payments"),
        F.concat(numbers.one_decimal(F.col("success_rate")), F.lit("%")).alias("success"),
        F.concat(numbers.one_decimal(F.col("refund_rate")), F.lit("%")).alias("refund"),
    )
