"""Row-level business rules: fees, settlement, events (K1, K2, K4)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from merchantlens.functions import numbers, rules
from merchantlens.schemas import MONEY
from merchantlens.sources.local import constant_table


def fee_rate(
    method: Column,
    rates: Mapping[str, Decimal] = rules.FEE_RATES,
    other: Decimal = rules.OTHER_FEE_RATE,
) -> Column:
    """K1: rate by payment method; unknown and null methods pay ``other``.

    The schedule is a handful of constants, so it is an expression, not a join.
    """
    rate = F.lit(other)
    for name, value in rates.items():
        rate = F.when(method == name, F.lit(value)).otherwise(rate)
    return rate


def settle(
    txns: DataFrame,
    rates: Mapping[str, Decimal] = rules.FEE_RATES,
    other: Decimal = rules.OTHER_FEE_RATE,
) -> DataFrame:
    """K2: fee, refund and net settlement of every transaction."""
    fee = F.col("transaction_amount") * fee_rate(F.col("payment_method"), rates, other)
    zero = "CAST(0 AS DECIMAL(18,2))"
    return (
        txns.withColumn("processing_fee", F.round(fee, 2).cast(MONEY))
        .withColumns(
            {
                "processing_fee": F.expr(
                    f"CASE WHEN payment_status = '{rules.SUCCESSFUL}' THEN processing_fee "
                    f"ELSE {zero} END"
                ),
                "refund_amount": F.expr(
                    f"CASE WHEN payment_status = '{rules.REFUNDED}' THEN transaction_amount "
                    f"ELSE {zero} END"
                ),
            }
        )
        .withColumn(
            "settlement_amount",
            F.expr(
                f"CASE WHEN payment_status IN ('{rules.SUCCESSFUL}', '{rules.REFUNDED}') "
                "THEN CAST(transaction_amount - processing_fee - refund_amount AS DECIMAL(18,2)) "
                f"ELSE {zero} END"
            ),
        )
    )


EFFECTS = T.StructType(
    [
        T.StructField("volume_mult", T.DoubleType()),
        T.StructField("success_prob", T.DoubleType()),
        T.StructField("refund_prob", T.DoubleType()),
        T.StructField("label", T.StringType()),
    ]
)


def event_table(
    spark: SparkSession, events: Iterable[rules.Event], of_method: bool, day: str = "agg_date"
) -> DataFrame:
    """The events of whole days, or those of one payment method, by their key.

    Events that share a key are merged, the later one first, so that a join
    never adds rows.
    """
    merged: dict[tuple, dict] = {}
    for event in events:
        if (event.payment_method is not None) == of_method:
            key = (event.event_date, event.payment_method) if of_method else (event.event_date,)
            known = {name: getattr(event, name) for name in EFFECTS.names}
            merged.setdefault(key, dict.fromkeys(EFFECTS.names)).update(
                {name: value for name, value in known.items() if value is not None}
            )
    keys = [T.StructField(day, T.DateType())]
    if of_method:
        keys.append(T.StructField("payment_method", T.StringType()))
    prefix = "_method_" if of_method else "_day_"
    effects = [T.StructField(prefix + f.name, f.dataType) for f in EFFECTS]
    rows = [(*key, *effect.values()) for key, effect in merged.items()]
    return constant_table(spark, rows, T.StructType(keys + effects))


def usual_success(method: Column) -> Column:
    """Success probability of an ordinary day."""
    return (
        F.when(method == "UPI", F.lit(rules.UPI_SUCCESS))
        .when(method.contains("Card"), F.lit(rules.CARD_SUCCESS))
        .otherwise(F.lit(rules.OTHER_SUCCESS))
    )


def event_calendar(
    df: DataFrame, events: Sequence[rules.Event] = rules.EVENTS, day: str = "agg_date"
) -> DataFrame:
    """K4: volume multiplier, success and refund probability of each row.

    An event of one payment method goes before an event of the whole day, and
    that before the usual value.  The events are constants of known size, which
    Catalyst broadcasts by itself.
    """
    spark = df.sparkSession
    joined = df.join(event_table(spark, events, False, day), day, "left").join(
        event_table(spark, events, True, day), [day, "payment_method"], "left"
    )

    def effect(name: str, *usual: Column) -> Column:
        return F.coalesce(F.col(f"_method_{name}"), F.col(f"_day_{name}"), *usual)

    return joined.select(
        *df.columns,
        effect("volume_mult", F.lit(1.0)).alias("volume_mult"),
        effect("success_prob", usual_success(F.col("payment_method"))).alias("success_prob"),
        effect("refund_prob", F.lit(rules.USUAL_REFUND)).alias("refund_prob"),
        effect("label").alias("event_label"),
    )


def event_effect(
    measures: DataFrame, events: Sequence[rules.Event] = rules.EVENTS
) -> DataFrame:
    """K4 next to what was observed, per day and payment method.

    ``measures`` needs ``payment_method``.  A payment succeeds unless it fails,
    and a refund follows a success, hence the two denominators.
    """
    observed = measures.groupBy("agg_date", "payment_method").agg(
        F.sum("total_transactions").alias("total_transactions"),
        F.sum("failed_transactions").alias("_failed"),
        F.sum("refunded_transactions").alias("_refunded"),
    )
    paid = F.col("total_transactions") - F.col("_failed")
    return (
        event_calendar(observed, events)
        .withColumn("observed_success_rate", numbers.percent(paid, F.col("total_transactions")))
        .withColumn("observed_refund_rate", numbers.percent(F.col("_refunded"), paid))
        .withColumn("expected_success_rate", F.lit(100.0) * F.col("success_prob"))
        .withColumn("expected_refund_rate", F.lit(100.0) * F.col("refund_prob"))
        .drop("_failed", "_refunded", "success_prob", "refund_prob")
    )
