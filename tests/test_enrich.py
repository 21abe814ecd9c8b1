from decimal import Decimal

import pytest
from helpers import day, rows
from pyspark.sql import functions as F

from merchantlens.functions import rules
from merchantlens.operators import enrich, kpis


def test_settlement_S1_S22(txns):
    got = rows(
        txns.select("transaction_id", "processing_fee", "refund_amount", "settlement_amount"),
        "transaction_id",
    )
    expected = {
        "t1": ("20.00", "0.00", "980.00"),
        "t2": ("0.00", "0.00", "500.00"),
        "t3": ("0.00", "200.00", "0.00"),
        "t4": ("0.00", "0.00", "0.00"),
        "t5": ("15.00", "0.00", "985.00"),
        "t6": ("1.80", "0.00", "98.20"),
        "t7": ("0.00", "0.00", "50.00"),
        "t8": ("0.00", "0.00", "10.00"),
    }
    assert got == [(k, *map(Decimal, v)) for k, v in expected.items()]


@pytest.mark.parametrize(
    "method, rate",
    [
        ("UPI", "0"),
        ("Credit Card", "0.02"),
        ("Debit Card", "0.009"),
        ("Net Banking", "0.015"),
        ("Wallet", "0.018"),
        ("Cheque", "0.018"),
        (None, "0.018"),
    ],
)
def test_fee_rate_K1(spark, method, rate):
    df = spark.createDataFrame([(method,)], "m string").select(enrich.fee_rate(F.col("m")))
    assert df.first()[0] == Decimal(rate)


def test_fee_rounds_half_up(spark, raw):
    odd = raw.limit(1).withColumn("transaction_amount", F.lit(Decimal("0.25")).cast("decimal(18,2)"))
    odd = odd.withColumn("payment_method", F.lit("Credit Card"))
    odd = odd.withColumn("payment_status", F.lit("Successful"))
    assert enrich.settle(odd).first().processing_fee == Decimal("0.01")


def test_event_calendar_K4(spark):
    df = spark.createDataFrame(
        [
            (day("2023-05-12"), "UPI"),
            (day("2024-08-05"), "UPI"),
            (day("2024-08-05"), "Wallet"),
            (day("2023-11-20"), "Debit Card"),
            (day("2023-11-21"), None),
        ],
        "agg_date date, payment_method string",
    )
    got = rows(enrich.event_calendar(df), "agg_date", "payment_method")
    assert [r[2:] for r in got] == [
        (0.2, 0.95, 0.03, "Gateway outage"),
        (1.0, 0.92, 0.15, "High refund day"),
        (1.0, 0.90, 0.03, None),
        (1.0, 0.60, 0.03, "High failure rate"),
        (1.0, 0.90, 0.03, None),
    ]


def test_events_of_one_day_do_not_multiply_rows(spark):
    twice = (
        rules.Event(day("2024-01-01"), "a", volume_mult=2.0),
        rules.Event(day("2024-01-01"), "b", refund_prob=0.5),
    )
    df = spark.createDataFrame([(day("2024-01-01"), "UPI")], "agg_date date, payment_method string")
    got = rows(enrich.event_calendar(df, twice))
    assert got == [(day("2024-01-01"), "UPI", 2.0, 0.95, 0.5, "b")]


def test_event_effect_rates(txns):
    effect = enrich.event_effect(kpis.measures(txns))
    got = {(r.agg_date, r.payment_method): r for r in effect.collect()}
    wallet = got[(day("2024-10-01"), "Wallet")]
    assert (wallet.observed_success_rate, wallet.observed_refund_rate) == (100.0, 100.0)
    debit = got[(day("2024-10-02"), "Debit Card")]
    assert (debit.observed_success_rate, debit.observed_refund_rate) == (0.0, None)
    assert debit.expected_success_rate == pytest.approx(92.0)
