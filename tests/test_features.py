import datetime as dt

import pytest
from helpers import day, rows, series_of

from merchantlens.functions.dates import Period
from merchantlens.operators import features


def test_feature_frame_E3_S10(ramp):
    built = features.build(ramp).orderBy("agg_date").collect()
    assert len(built) == 10
    first = built[0]
    assert first.agg_date == day("2024-01-31") and first.net_revenue == 31.0
    lags = (first.revenue_lag_1, first.revenue_lag_7, first.revenue_lag_14, first.revenue_lag_30)
    assert lags == (30.0, 24.0, 17.0, 1.0)
    assert (first.rolling_avg_7d, first.rolling_avg_30d) == (27.0, 15.5)
    calendar = (first.day_of_week, first.day_of_month, first.month, first.is_weekend)
    assert calendar == (2, 31, 1, 0)


def test_calendar_S15(ramp):
    built = {r.agg_date: r for r in features.build(ramp).collect()}
    saturday, monday = built[day("2024-02-03")], built[day("2024-02-05")]
    assert (saturday.day_of_week, saturday.is_weekend) == (5, 1)
    assert (monday.day_of_week, monday.is_weekend) == (0, 0)


def test_short_series_has_no_features(spark):
    assert features.build(series_of(spark, range(29))).count() == 0


def test_null_in_window_S9(spark):
    values = [float(i) for i in range(20)]
    values[10] = None
    means = rows(features.rolling_means(series_of(spark, values)), "agg_date")
    for i, row in enumerate(means):
        window = values[max(0, i - 7) : i]
        full = len(window) == 7 and None not in window
        assert row[3] == (pytest.approx(sum(window) / 7) if full else None)


def test_lags_go_by_row_S8(spark):
    data = [("s", day(d), v) for d, v in (("2024-01-01", 1.0), ("2024-01-05", 2.0))]
    df = spark.createDataFrame(data, "series_key string, agg_date date, net_revenue double")
    assert [r.revenue_lag_1 for r in features.lags(df).orderBy("agg_date").collect()] == [None, 1.0]


def test_date_spine_K5(spark):
    data = [
        ("a", day("2024-01-02"), 1.0),
        ("a", day("2024-01-05"), 2.0),
        ("b", day("2024-01-01"), 3.0),
    ]
    df = spark.createDataFrame(data, "series_key string, agg_date date, net_revenue double")
    got = {(r.series_key, r.agg_date.day): r.net_revenue for r in features.date_spine(df).collect()}
    assert got == {
        **{("a", d): v for d, v in zip(range(1, 6), (0.0, 1.0, 0.0, 0.0, 2.0))},
        **{("b", d): v for d, v in zip(range(1, 6), (3.0, 0.0, 0.0, 0.0, 0.0))},
    }
    wide = features.date_spine(df, Period.of("2023-12-31", "2024-01-03"))
    assert wide.count() == 8
    assert wide.agg({"net_revenue": "sum"}).first()[0] == 4.0


def test_daily_series_levels_D11(frame, merchants):
    platform = features.daily_series(frame)
    assert rows(platform, "agg_date") == [
        ("Platform", day("2024-10-01"), 2465.0),
        ("Platform", day("2024-10-02"), 98.2),
        ("Platform", day("2024-10-03"), 60.0),
    ]
    category = features.daily_series(frame, features.CATEGORY, merchants)
    assert ("SaaS", day("2024-10-02"), 0.0) in rows(category)
    merchant = features.daily_series(frame, features.MERCHANT)
    assert ("m3", day("2024-10-03"), 10.0) in rows(merchant)
    with pytest.raises(ValueError):
        features.daily_series(frame, "Region")


def test_spine_before_features_counts_days(spark):
    sparse = [("s", day("2024-01-01") + dt.timedelta(days=2 * i), 1.0) for i in range(40)]
    df = spark.createDataFrame(sparse, "series_key string, agg_date date, net_revenue double")
    built = features.build(features.date_spine(df)).collect()
    assert len(built) == 79 - 30
    assert {r.rolling_avg_30d for r in built} == {0.5}


def test_spine_over_named_series(spark):
    series = series_of(spark, [5], start="2024-01-02", key="a")
    keys = spark.createDataFrame([("a",), ("b",)], "series_key string")
    period = Period.of("2024-01-01", "2024-01-03")
    got = rows(features.date_spine(series, period, keys))
    days = [day("2024-01-01"), day("2024-01-02"), day("2024-01-03")]
    assert got == sorted(
        [("a", d, 5.0 if d == days[1] else 0.0) for d in days] + [("b", d, 0.0) for d in days], key=str
    )
