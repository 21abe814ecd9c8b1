import pytest
from helpers import day, rows, series_of

from merchantlens import schemas
from merchantlens.functions.dates import Period
from merchantlens.operators import forecast
from merchantlens.sources import readers, writers


def test_baseline_I4_S14(ramp):
    got = {r.target_date: r for r in forecast.baseline(ramp).collect()}
    assert len(got) == 30 and min(got) == day("2024-02-10") and max(got) == day("2024-03-10")
    saturday, monday = got[day("2024-02-10")], got[day("2024-02-12")]
    assert saturday.predicted_revenue == pytest.approx(20.40)
    assert (saturday.confidence_lower, saturday.confidence_upper) == pytest.approx((16.32, 24.48))
    assert monday.predicted_revenue == pytest.approx(28.05)
    assert (monday.confidence_lower, monday.confidence_upper) == pytest.approx((22.44, 33.66))
    assert saturday.model_name == "Baseline_EWMA" and saturday.forecast_level == "Platform"


def test_baseline_needs_thirty_values(spark):
    short = forecast.baseline(series_of(spark, range(29))).collect()
    assert len(short) == 30 and {r.predicted_revenue for r in short} == {None}
    gap = forecast.baseline(series_of(spark, [None, *range(29)])).collect()
    assert {r.predicted_revenue for r in gap} == {None}


def test_baseline_noise_stays_within_bounds(ramp):
    exact = {r.target_date: r.predicted_revenue for r in forecast.baseline(ramp).collect()}
    noisy = forecast.baseline(ramp, noise=0.05).collect()
    ratios = [r.predicted_revenue / exact[r.target_date] for r in noisy]
    assert all(0.95 <= x <= 1.05 for x in ratios) and len(set(ratios)) > 1


def test_future_dates_I2(ramp):
    got = rows(forecast.future_dates(ramp, 3))
    assert got == [("s", day(f"2024-02-{d}")) for d in (10, 11, 12)]


def test_window_has_no_lower_bound_S16(ramp):
    forecasts = forecast.baseline(ramp, horizon=90)
    late = forecast.window(forecasts, Period.of("2024-03-01", "2024-03-31"), 7)
    assert late.agg({"target_date": "min"}).first()[0] == day("2024-02-10")
    assert late.agg({"target_date": "max"}).first()[0] == day("2024-04-07")


def test_overlay_G1(spark, ramp):
    actual = ramp.selectExpr("agg_date", "net_revenue AS net_rev")
    shown = forecast.overlay(actual, forecast.baseline(ramp, horizon=2))
    assert shown.groupBy("kind").count().orderBy("kind").collect() == [("actual", 40), ("forecast", 2)]
    assert shown.where("kind = 'actual' AND lower IS NOT NULL").count() == 0


def test_backtest_I8(spark):
    flat = series_of(spark, [100.0] * 60)
    row = forecast.backtest(flat).first()
    # Rows 31..60 run from 2024-01-31: 22 weekdays and 8 weekend days.
    assert row.scored_days == 30
    assert row.mape == pytest.approx((22 * 0.1 + 8 * 0.2) / 30)


def test_mape_skips_days_of_zero(spark):
    df = spark.createDataFrame([("s", 0.0, 5.0), ("s", 10.0, 5.0)], "series_key string, y double, p double")
    assert rows(forecast.mape(df, "y", "p")) == [("s", 1, 0.5)]


def test_label_features_C2_S20_S21(spark):
    data = [("month", 0.1), ("revenue_lag_1", 0.5), ("is_weekend", 0.2), ("a", 0.05), ("b", 0.05),
            ("c", 0.05), ("d", 0.05)]
    importance = spark.createDataFrame(data, schemas.FEATURE_IMPORTANCE)
    got = [tuple(r) for r in forecast.label_features(importance).collect()]
    assert [r[:2] for r in got] == [
        ("revenue_lag_1", "Sales from Yesterday"),
        ("is_weekend", "Weekend Effect"),
        ("month", "month"),
        ("a", "a"),
        ("b", "b"),
        ("c", "c"),
    ]
    assert [r[2] for r in got] == pytest.approx([50, 20, 10, 5, 5, 5])


def test_write_forecasts_A7(spark, ramp, tmp_path):
    path = str(tmp_path / "forecasts")
    other = ramp.selectExpr("'r' AS series_key", "agg_date", "net_revenue")
    writers.write_forecasts(forecast.baseline(ramp.union(other), horizon=5), path)
    writers.write_forecasts(forecast.baseline(ramp.union(other), horizon=3), path)
    stored = readers.read_table(spark, path)
    assert stored.schema.simpleString() == schemas.FORECASTS.simpleString()
    ordered = stored.orderBy("forecast_level", "series_key", "target_date").collect()
    ids = [r.forecast_id for r in ordered]
    assert len(ids) == 6 and ids == sorted(set(ids)) and ids[0] == 1
