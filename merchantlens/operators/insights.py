"""Alerts, anomaly flags and answers to questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.functions import numbers, rules
from merchantlens.operators import kpis
from merchantlens.operators.features import by_series


def top_method(mix: DataFrame) -> DataFrame:
    """The most used payment method and its share, null counted.

    ``mix`` is a payment mix; ties go by name.
    """
    share = numbers.percent(F.col("txn_count"), F.col("total_txns"))
    return (
        mix.orderBy(F.desc("txn_count"), F.asc_nulls_last("payment_method"))
        .limit(1)
        .select(
            F.col("payment_method").alias("top_method"),
            "txn_count",
            share.alias("top_share"),
        )
    )


def refund_alerts(
    frame: DataFrame, *keys: str, above: float = rules.ALERT_REFUND_RATE
) -> DataFrame:
    """Groups whose refund rate is strictly above the threshold."""
    sums = kpis.rollup_to(frame, *keys)
    rate = numbers.percent(F.col("refunded_transactions"), F.col("total_transactions"))
    flagged = sums.withColumn("refund_rate", rate).where(F.col("refund_rate") > above)
    return flagged.select(*keys, "total_transactions", "refunded_transactions", "refund_rate")


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word.lower())
    return found


def route(
    questions: DataFrame,
    intents: Sequence[tuple[str, Sequence[str]]] = rules.INTENTS,
    default: str = rules.DEFAULT_INTENT,
) -> DataFrame:
    """The intent of each question; the first rule that matches wins."""
    text = F.lower("text")
    intent = F.lit(default)
    for name, words in reversed(intents):
        intent = F.when(contains_any(text, words), F.lit(name)).otherwise(intent)
    return questions.withColumn("intent", F.coalesce(intent, F.lit(default)))


def facts(headline: DataFrame, top: DataFrame) -> dict[str, Column]:
    """The figures answers quote, as scalar subqueries: one row each, no join."""
    kpi = headline.agg(F.first(F.struct("total_rev", "total_txns", "refund_rate"))).scalar()
    method = top.agg(F.first(F.struct("top_method", "top_share"))).scalar()
    return {
        "total_rev": kpi.getField("total_rev"),
        "total_txns": kpi.getField("total_txns"),
        "refund_rate": kpi.getField("refund_rate"),
        "top_method": method.getField("top_method"),
        "top_share": method.getField("top_share"),
    }


def answers(
    routed: DataFrame,
    headline: DataFrame,
    top: DataFrame,
    horizon: int = rules.HORIZON,
    verdict_above: float = rules.VERDICT_REFUND_RATE,
) -> DataFrame:
    """The answer to each routed question; the same one to all when nothing was selected."""
    known = facts(headline, top)
    method = F.coalesce(known["top_method"], F.lit("None"))
    refund = numbers.one_decimal(known["refund_rate"])
    payment = F.format_string(
        rules.ANSWER_PAYMENT, method, numbers.one_decimal(known["top_share"]), method
    )
    verdict = F.when(
        known["refund_rate"] > verdict_above, F.format_string(rules.ANSWER_REFUND_HIGH, refund)
    ).otherwise(F.format_string(rules.ANSWER_REFUND_HEALTHY, refund))
    outlook = F.format_string(rules.ANSWER_FORECAST, F.lit(str(horizon)))
    totals = F.format_string(
        rules.ANSWER_DEFAULT,
        numbers.thousands(known["total_txns"]),
        numbers.crores(known["total_rev"]),
    )
    intent = F.col("intent")
    return routed.withColumn(
        "answer",
        F.when(known["total_rev"].isNull(), F.lit(rules.ANSWER_NO_DATA))
        .when(intent == "payment", payment)
        .when(intent == "refund", verdict)
        .when(intent == "forecast", outlook)
        .otherwise(totals),
    )


def anomalies(
    series: DataFrame,
    metrics: Sequence[str] = ("net_revenue", "failure_rate", "refund_rate"),
    rows: int = rules.HISTORY,
    beyond: float = 3.0,
) -> DataFrame:
    """Days on which a metric lies far from its preceding ``rows`` rows.

    One z-score per metric, NULL until the window is full or where the window
    does not vary; a row is kept when any of them is beyond the limit.
    """
    frame = by_series().rowsBetween(-rows, -1)
    scored = series
    for metric in metrics:
        spread = F.nullif(F.stddev_samp(metric).over(frame), F.lit(0.0))
        z = F.try_divide(F.col(metric) - F.avg(metric).over(frame), spread)
        scored = scored.withColumn(
            f"z_{metric}", F.when(F.count(metric).over(frame) == rows, z)
        )
    flagged = F.lit(False)
    for metric in metrics:
        flagged = flagged | F.coalesce(F.abs(f"z_{metric}") > beyond, F.lit(False))
    return scored.where(flagged).select(
        "series_key", "agg_date", *metrics, *[f"z_{m}" for m in metrics]
    )


def payment_mix_anomalies(
    counts: DataFrame,
    methods: Sequence[str] = rules.PAYMENT_METHODS,
    rows: int = rules.HISTORY,
    beyond: float = 3.0,
) -> DataFrame:
    """N1 for payment methods: days whose mix departs from that of the preceding ``rows`` rows.

    ``counts`` has ``series_key``, ``agg_date``, ``payment_method`` and ``total_transactions``
    and may have several rows a day; other and missing methods count as one.  The mix
    before, with half a payment added to each method, gives what a day's payments should be.
    ``chi_square`` is the squared departure over that, ``z_mix`` its distance from the mean
    of its distribution in standard deviations, ``psi`` the stability index of the two mixes,
    ``method`` the one that departs most (ties by name).  NULL until the window is full.
    """
    names = [f"_{n}" for n in range(len(methods) + 1)]
    of = [F.col("payment_method").eqNullSafe(method) for method in methods]
    other = ~F.coalesce(F.col("payment_method").isin(*methods), F.lit(False))
    sums = [F.sum(F.when(c, F.col("total_transactions")).otherwise(0)) for c in (*of, other)]
    daily = counts.groupBy("series_key", "agg_date").agg(*[s.alias(n) for s, n in zip(sums, names)])
    before = by_series().rowsBetween(-rows, -1)
    full = F.count(F.lit(1)).over(before) == rows
    daily = daily.withColumns(
        {f"{n}_q": F.when(full, F.sum(n).over(before) + 0.5) for n in names}
        | {"total_transactions": sum((F.col(n) for n in names[1:]), F.col(names[0]))}
    )
    usual = sum((F.col(f"{n}_q") for n in names[1:]), F.col(f"{names[0]}_q"))
    total = F.col("total_transactions")
    seen = total + 0.5 * len(names)
    chi, psi, departures = F.lit(0.0), F.lit(0.0), []
    for label, name in zip((*methods, "Other"), names):
        q = F.col(f"{name}_q") / usual
        p = (F.col(name) + 0.5) / seen
        departure = (F.col(name) - total * q) * (F.col(name) - total * q) / (total * q)
        chi, psi = chi + departure, psi + (p - q) * F.log(p / q)
        departures.append(F.struct(-F.round(departure, 9), F.lit(label).alias("label")))
    free = len(names) - 1
    scored = daily.where(total > 0).select(
        "series_key",
        "agg_date",
        "total_transactions",
        chi.alias("chi_square"),
        ((chi - free) / (2.0 * free) ** 0.5).alias("z_mix"),
        psi.alias("psi"),
        F.least(*departures)["label"].alias("method"),
    )
    return scored.where(F.col("z_mix") > beyond)
