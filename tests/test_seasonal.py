"""Trend and seasons found in planted series (K3)."""

import datetime as dt
import math

import pytest
from helpers import day, plan, rows

from merchantlens.operators import seasonal

WEEK = [1.2, 1.1, 1.0, 1.0, 0.9, 0.7, 1.1]
YEAR = [0.8, 0.9, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.2, 1.2, 0.9]
SCHEMA = "business_category string, agg_date date, total_transactions double"


def of_month(day_of_month):
    return 1.3 if day_of_month <= 5 else 0.95


def planted(series, days=4 * 365, growth=0.25, base=1000.0):
    found = []
    for n in range(days):
        at = dt.date(2020, 1, 1) + dt.timedelta(days=n)
        value = base * (1 + growth * n / 365) * WEEK[at.weekday()] * of_month(at.day) * YEAR[at.month - 1]
        found.append((series, at, value))
    return found


@pytest.fixture(scope="module")
def found(spark):
    data = planted("up") + planted("flat", growth=0.0) + planted("down", growth=-0.1, base=50.0)
    return seasonal.decompose(spark.createDataFrame(data, SCHEMA)).cache()


def test_planted_factors_are_found(found):
    factors = {(r.business_category, r.kind, r.level): r.factor for r in seasonal.factors(found).collect()}
    assert len(factors) == 3 * (7 + 31 + 12)
    scale = {"weekday": sum(WEEK) / 7, "month": sum(YEAR) / 12, "day_of_month": (5 * 1.3 + 26 * 0.95) / 31}
    for (_, kind, level), factor in factors.items():
        true = {"weekday": lambda: WEEK[level], "month": lambda: YEAR[level - 1], "day_of_month": lambda: of_month(level)}
        assert factor == pytest.approx(true[kind]() / scale[kind], rel=0.05), (kind, level)


def test_growth_is_found(found):
    growth = {r.business_category: r.annual_growth for r in found.select("business_category", "annual_growth").distinct().collect()}
    mean = {"up": 0.25 / 1.5, "flat": 0.0, "down": -0.1 / 0.8}  # over the mean of four years
    assert growth == {name: pytest.approx(value, abs=0.02) for name, value in mean.items()}


def test_little_is_left_unexplained(found):
    left = [math.log(r.irregular) for r in found.collect()]
    assert max(map(abs, left)) < 0.2 and abs(sum(left) / len(left)) < 0.02


def test_short_and_empty_series(spark):
    data = [("one", day("2024-01-01"), 5.0), ("two", day("2024-01-01"), None), ("two", day("2024-01-03"), 4.0)]
    got = {r.agg_date.isoformat() + r.business_category: r for r in seasonal.decompose(spark.createDataFrame(data, SCHEMA)).collect()}
    one = got["2024-01-01one"]
    assert (one.trend, one.expected_index, one.observed_index, one.annual_growth) == (5.0, 1.0, 1.0, 0.0)
    assert got["2024-01-01two"].observed_index is None
    assert seasonal.decompose(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_shuffle(spark):
    days = spark.createDataFrame(planted("a", days=60), SCHEMA)
    assert plan(seasonal.decompose(days)).count("Exchange hashpartitioning") == 1


def test_rows_in_any_order(spark, found):
    data = planted("flat", growth=0.0)
    again = seasonal.decompose(spark.createDataFrame(data[::-1], SCHEMA).repartition(7))
    assert rows(again.selectExpr("agg_date", "round(expected_index, 9)")) == rows(
        found.where("business_category = 'flat'").selectExpr("agg_date", "round(expected_index, 9)")
    )
