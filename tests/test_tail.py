"""The table of the last rows of every series."""

import datetime as dt

import pytest
from helpers import rows
from pyspark.sql import functions as F

from merchantlens.operators import features, forecast, learning
from merchantlens.plans import forecasting, load, tail
from merchantlens.sources import writers
from test_gate import files, transactions  # noqa: F401


@pytest.fixture
def house(spark, files):  # noqa: F811
    load.load(spark, str(files / "m.csv"), str(files / "t.csv"), str(files / "house"))
    return load.Warehouse(str(files / "house"))


def from_history(spark, house, level):
    daily, merchants = house.table(spark, "daily_aggregates"), house.table(spark, "merchants")
    return features.daily_series(daily, level, merchants)


def test_equal_to_the_full_read_before_and_after_an_append(spark, house, files):  # noqa: F811
    for _ in range(2):
        for level in tail.LEVELS:
            last, whole = tail.series(spark, house.path("series_tail"), level), from_history(spark, house, level)
            assert rows(last) == rows(forecast.last_rows(whole, 30).drop("age").select(*last.columns))
            assert rows(forecast.baseline(last)) == rows(forecast.baseline(whole))
            assert rows(learning.start(last)) == rows(learning.start(whole))
        load.append(spark, str(files / "more.csv"), house.root)
    assert len(tail._versions(spark, house.path("series_tail"))) >= 2


def test_a_forecast_reads_no_history(spark, house):
    last = tail.series(spark, house.path("series_tail"), "Platform")
    for df in (forecast.baseline(last), learning.start(last)):
        assert df.inputFiles() and all("/series_tail/" in name for name in df.inputFiles())
    stored = forecasting.forecast(spark, house.root, horizon=3, use_trees=False)
    assert stored.count() == 3 and {r.model_name for r in stored.collect()} == {"Baseline_EWMA"}


def test_corrected_and_late_days(spark, tmp_path):
    first = [("Platform", "p", dt.date(2024, 1, 1) + dt.timedelta(days=n), float(n)) for n in range(40)]
    old = tail._last(spark.createDataFrame(first, tail.SCHEMA))
    new = [("Platform", "p", dt.date(2024, 2, 9), 99.0), ("Platform", "p", dt.date(2024, 2, 10), 1.0)]
    new += [("Platform", "p", dt.date(2023, 5, 1), 5.0), ("Merchant", "p", dt.date(2024, 2, 9), 3.0)]
    got = tail.merged(old, spark.createDataFrame(new, tail.SCHEMA))
    platform = got.where("forecast_level = 'Platform'").orderBy(F.desc("agg_date")).collect()
    assert len(platform) == 30 and [r.net_revenue for r in platform[:3]] == [1.0, 99.0, 38.0]
    assert got.where("forecast_level = 'Merchant'").count() == 1


def test_a_version_that_was_not_completed_is_not_read(spark, house, files):  # noqa: F811
    path = house.path("series_tail")
    before = rows(tail.read(spark, path))
    (files / "house" / "series_tail" / "version=7").mkdir()
    assert rows(tail.read(spark, path)) == before
    with pytest.raises(ValueError, match="no table"):
        tail.update(house.table(spark, "daily_aggregates"), house.table(spark, "merchants"), str(files / "none"))


def test_without_the_table_the_history_is_read(spark, tmp_path):
    house = load.Warehouse(str(tmp_path))
    txns = transactions(spark, range(90))
    writers.store_transactions(txns, house.path("transactions"))
    load.refresh(spark, house.root, load.months_of(txns))
    assert tail.series(spark, house.path("series_tail"), "Platform") is None
    assert forecasting.forecast(spark, house.root, horizon=2, use_trees=False).count() == 2
