import datetime as dt
import math

import pytest
from helpers import day, rows
from pyspark.sql import functions as F

from merchantlens.functions.dates import Period
from merchantlens.operators import insights, kpis, segments
from merchantlens.operators.filters import Filters

DAYS = Period.of("2024-10-01", "2024-10-03")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_route_J3_S19(spark):
    questions = {
        "What is my best PAYMENT method?": "payment",
        "Did refunds hit my payment volume?": "payment",
        "Why did revenue drop?": "refund",
        "What does the future hold after the drop?": "refund",
        "Forecast next month": "forecast",
        "Hello": "default",
        None: "default",
    }
    routed = insights.route(asked(spark, *questions))
    assert {r.text: r.intent for r in routed.collect()} == questions


def test_top_method_D13(txns):
    whole = segments.payment_mix(txns, DAYS, include_end=True)
    assert rows(insights.top_method(whole)) == [("UPI", 3, 37.5)]
    tied = segments.payment_mix(txns, DAYS)
    assert insights.top_method(tied).first().top_method == "Credit Card"


def test_answers_J4_S18(spark, txns, merchants):
    headline = kpis.headline(kpis.measures(txns), merchants, Filters(DAYS))
    top = insights.top_method(segments.payment_mix(txns, DAYS, include_end=True))
    routed = insights.route(asked(spark, "payment?", "refund?", "future?", "hi"))
    got = {r.intent: r.answer for r in insights.answers(routed, headline, top).collect()}
    assert "**UPI** is your most popular payment method, accounting for **37.5%**" in got["payment"]
    assert "currently at **14.3%**, which is higher than the platform average of 2.5%." in got["refund"]
    assert got["forecast"].startswith("Looking ahead 30 days")
    assert "**7** payments totaling **₹0.00 Cr**" in got["default"]
    calm = insights.answers(routed, headline, top, verdict_above=15.0)
    assert "healthy at **14.3%**" in {r.intent: r.answer for r in calm.collect()}["refund"]


def test_answers_without_data(spark, txns, merchants):
    never = Filters(Period.of("2030-01-01", "2030-01-31"))
    headline = kpis.headline(kpis.measures(txns), merchants, never)
    top = insights.top_method(segments.payment_mix(txns, never.period))
    routed = insights.route(asked(spark, "payment?", "refund?", "future?", "hi"))
    got = {r.answer for r in insights.answers(routed, headline, top).collect()}
    assert got == {"No data found for the selected filters."}


def test_refund_alerts_J1(frame):
    assert rows(insights.refund_alerts(frame, "agg_date")) == [(day("2024-10-01"), 4, 1, 25.0)]
    assert rows(insights.refund_alerts(frame, "agg_date", above=25.0)) == []


def test_anomalies_N1(spark):
    values = [100.0 + (i % 2) for i in range(40)] + [500.0]
    data = [("s", i, v, 0.0) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "series_key string, n int, net_revenue double, refund_rate double")
    df = df.withColumn("agg_date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    found = insights.anomalies(df, ("net_revenue", "refund_rate")).collect()
    assert [r.agg_date for r in found] == [day("2024-02-10")]
    assert found[0].z_refund_rate is None  # the preceding rates do not vary
    spread = (30 / 29 * 0.25) ** 0.5
    assert found[0].z_net_revenue == pytest.approx((500 - 100.5) / spread)


def test_payment_mix_anomalies_N1(spark):
    usual = {"UPI": 50, "Credit Card": 30, None: 10, "Cheque": 10}
    data = []
    for n in range(45):
        mix = {"Wallet": 90, "UPI": 10} if n == 40 else usual
        for method, count in mix.items():
            data.append(("Platform", day("2024-01-01") + dt.timedelta(days=n), method, count))
        data.append(("quiet", day("2024-01-01") + dt.timedelta(days=n), "UPI", 0 if n % 2 else 3))
    counts = spark.createDataFrame(
        data, "series_key string, agg_date date, payment_method string, total_transactions long"
    )
    found = insights.payment_mix_anomalies(counts.repartition(5)).orderBy("agg_date").collect()
    assert [(r.series_key, r.agg_date, r.method, r.total_transactions) for r in found] == [
        ("Platform", day("2024-02-10"), "Wallet", 100)
    ]
    # Expected by hand: 30 days before hold 1,500, 900, 0, 0, 0 and 600 payments, half a one added to each.
    before = [1500.5, 900.5, 0.5, 0.5, 0.5, 600.5]
    seen = [10, 0, 0, 0, 90, 0]
    chi = sum((o - 100 * b / sum(before)) ** 2 / (100 * b / sum(before)) for o, b in zip(seen, before))
    psi = sum(((o + 0.5) / 103 - b / sum(before)) * math.log((o + 0.5) / 103 / (b / sum(before))) for o, b in zip(seen, before))
    assert found[0].chi_square == pytest.approx(chi) and found[0].psi == pytest.approx(psi)
    assert found[0].z_mix == pytest.approx((chi - 5) / math.sqrt(10))
    assert insights.payment_mix_anomalies(counts.limit(0)).count() == 0
