import pytest
from helpers import day, rows

from merchantlens.functions.dates import Period
from merchantlens.operators import kpis
from merchantlens.operators.filters import Filters


def span(start, end, **choice):
    return Filters(Period.of(f"2024-{start}", f"2024-{end}"), **choice)


def test_daily_kpis_D1_S2(daily):
    columns = (
        "agg_date",
        "merchant_id",
        "gross_revenue",
        "net_revenue",
        "total_transactions",
        "successful_transactions",
        "failed_transactions",
        "refunded_transactions",
        "avg_transaction_value",
        "processing_fees",
        "refund_total",
    )
    d1, d2, d3 = day("2024-10-01"), day("2024-10-02"), day("2024-10-03")
    assert rows(daily.select(*columns), "agg_date", "merchant_id") == [
        (d1, "m1", 1500.0, 1480.0, 3, 2, 0, 1, 750.0, 20.0, 200.0),
        (d1, "m2", 1000.0, 985.0, 1, 1, 0, 0, 1000.0, 15.0, 0.0),
        (d2, "m1", 0.0, 0.0, 1, 0, 1, 0, None, 0.0, 0.0),
        (d2, "m2", 100.0, 98.2, 1, 1, 0, 0, 100.0, 1.8, 0.0),
        (d3, "m2", 50.0, 50.0, 1, 1, 0, 0, 50.0, 0.0, 0.0),
        (d3, "m3", 10.0, 10.0, 1, 1, 0, 0, 10.0, 0.0, 0.0),
    ]


def test_platform_trend_D2(frame):
    assert rows(kpis.platform_trend(frame), "agg_date") == [
        (day("2024-10-01"), 2500.0, 4),
        (day("2024-10-02"), 100.0, 2),
        (day("2024-10-03"), 60.0, 2),
    ]


def test_daily_rates_D5(frame):
    assert rows(kpis.daily_rates(frame), "agg_date") == [
        (day("2024-10-01"), 75.0, 0.0, 25.0),
        (day("2024-10-02"), 50.0, 50.0, 0.0),
        (day("2024-10-03"), 100.0, 0.0, 0.0),
    ]


def test_headline_D6(frame, merchants):
    row = kpis.headline(frame, merchants, span("10-01", "10-03")).first()
    assert (row.total_rev, row.total_txns, row.has_data) == (2613.2, 7, True)
    assert row.success_rate == pytest.approx(71.428571)
    assert row.refund_rate == pytest.approx(14.285714)


def test_headline_without_rows_S24(frame, merchants):
    got = rows(kpis.headline(frame, merchants, span("11-01", "11-05")))
    assert got == [(None, None, None, None, False)]


@pytest.mark.parametrize(
    "start, end, revenue, previous, trend, direction, alert",
    [
        ("10-01", "10-03", 2613.2, 2465.0, 6.012170, "up", True),
        ("10-02", "10-03", 148.2, 2563.2, -94.218165, "down", False),
        ("10-01", "10-01", 2465.0, 2465.0, 0.0, "up", True),
    ],
)
def test_period_compare_D7_S3(
    frame, merchants, start, end, revenue, previous, trend, direction, alert
):
    row = kpis.period_compare(frame, merchants, span(start, end)).first()
    assert (row.total_rev, row.prev_rev, row.direction) == (revenue, previous, direction)
    assert row.rev_trend == pytest.approx(trend, abs=1e-6)
    assert row.refund_alert is alert and row.has_data


def test_period_compare_without_base_S4(frame, merchants):
    row = kpis.period_compare(frame, merchants, span("10-03", "10-03"), overlap=False).first()
    assert (row.total_rev, row.prev_rev) == (50.0, 98.2)
    row = kpis.period_compare(frame, merchants, span("10-01", "10-03"), overlap=False).first()
    assert (row.prev_rev, row.rev_trend, row.direction) == (2613.2, 0.0, "up")


def test_period_compare_without_rows(frame, merchants):
    row = kpis.period_compare(frame, merchants, span("11-01", "11-05")).first()
    assert (row.total_rev, row.rev_trend, row.direction) == (None, None, None)
    assert (row.refund_alert, row.has_data) == (False, False)


def test_cards_H14(frame, merchants):
    compared = kpis.period_compare(frame, merchants, span("10-01", "10-03"))
    assert rows(kpis.cards(compared)) == [("₹0.00 Cr", "▲ 6.0%", "7", "71.4%", "14.3%")]
    empty = kpis.period_compare(frame, merchants, span("11-01", "11-05"))
    assert rows(kpis.cards(empty)) == []


def test_revenue_series_D8_B4(frame, merchants):
    series = kpis.revenue_series(frame, merchants, span("10-01", "10-03", category="Travel"))
    assert rows(series, "agg_date") == [
        (day("2024-10-01"), 985.0),
        (day("2024-10-02"), 98.2),
        (day("2024-10-03"), 50.0),
    ]
    one = kpis.revenue_series(frame, merchants, span("10-01", "10-03", merchant="Merchant_1"))
    assert rows(one, "agg_date") == [(day("2024-10-01"), 1480.0), (day("2024-10-02"), 0.0)]


def test_filtered_daily_and_report_A11(daily, merchants):
    chosen = span("10-02", "10-03")
    kept = kpis.filtered_daily(daily, merchants, chosen)
    assert {(r.merchant_name, r.agg_date) for r in kept.collect()} == {
        ("Merchant_1", day("2024-10-02")),
        ("Merchant_2", day("2024-10-02")),
        ("Merchant_2", day("2024-10-03")),
    }
    report = kpis.report_rows(daily, merchants, chosen)
    assert report.columns == ["agg_date", "net_revenue", "total_transactions"]
    assert report.count() == 3


def test_previous_period_S3():
    chosen = Period.of("2024-10-01", "2024-12-31")
    assert chosen.previous() == Period.of("2024-07-02", "2024-10-01")
    assert chosen.previous(overlap=False) == Period.of("2024-07-01", "2024-09-30")
