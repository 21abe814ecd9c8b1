"""The choice of a model by its errors at rolling origins."""

import datetime as dt

import pytest
from helpers import day, series_of
from pyspark.sql import functions as F

from merchantlens.operators import choice, forecast, learning


def last_value(inputs):
    return inputs["revenue_lag_1"].cast("double")


def plain_errors(values, score, origins, step, ahead, start):
    """Mean errors of the baseline and of a score of the value before."""
    errors = {"baseline": [], "model": []}
    for origin in range(origins):
        cut = len(values) - origin * step - ahead
        known, held = values[max(0, cut - 30) : cut], values[cut : cut + ahead]
        if cut < 1:
            continue
        state = list(known)
        for n, actual in enumerate(held):
            # Days to come follow the last known one.
            weekend = (start + dt.timedelta(days=cut + n)).weekday() >= 5
            state.append(max(0.0, score(state)))
            if not actual:
                continue
            errors["model"].append(abs((actual - state[-1]) / actual))
            if len(known) == 30:
                base = sum(known) / 30 * (0.8 if weekend else 1.1)
                errors["baseline"].append(abs((actual - base) / actual))
    return {name: sum(e) / len(e) if e else None for name, e in errors.items()}


@pytest.fixture(scope="module")
def three(spark):
    weekly = [80.0 if (day("2024-01-01") + dt.timedelta(days=n)).weekday() >= 5 else 110.0 for n in range(70)]
    rising = [100.0 * 1.05**n for n in range(70)]
    short = [50.0 + n % 3 for n in range(34)]
    tiny = [7.0, 8.0]
    values = {"weekly": weekly, "rising": rising, "short": short, "1:tiny": tiny}
    df = None
    for key, of in values.items():
        one = series_of(spark, of, key=key)
        df = one if df is None else df.unionByName(one)
    return values, df


def test_errors_against_plain_version(three):
    values, series = three
    got = {r.series_key: r for r in choice.choose(series, last_value, name="Last").collect()}
    for key, of in values.items():
        expected = plain_errors(of, lambda state: state[-1], 3, 10, 10, day("2024-01-01"))
        for name in ("baseline", "model"):
            found = got[key][f"mape_{name}"]
            assert found == (None if expected[name] is None else pytest.approx(expected[name])), (key, name)
    names = {key: r.model_name for key, r in got.items()}
    assert names == {"weekly": "Baseline_EWMA", "rising": "Last", "short": "Last", "1:tiny": "Baseline_EWMA"}


def test_each_series_has_the_forecast_of_its_better_model(three):
    _, series = three
    chosen = choice.choose(series, last_value, name="Last")
    found = choice.run(series, last_value, chosen, 5, "Category", name="Last")
    names = {(r.series_key, r.model_name) for r in found.collect()}
    assert names == {("weekly", "Baseline_EWMA"), ("rising", "Last"), ("short", "Last"), ("1:tiny", "Baseline_EWMA")}
    alone = {
        "Baseline_EWMA": forecast.baseline(series, 5, "Category"),
        "Last": learning.recursive(series, last_value, 5, "Category", name="Last"),
    }
    for name, whole in alone.items():
        key = ["series_key", "target_date", "predicted_revenue"]
        mine = found.where(F.col("model_name") == name).select(*key)
        assert mine.exceptAll(whole.select(*key)).isEmpty()
    assert found.count() == 20


def test_no_model_is_scored_on_what_it_has_seen(three):
    _, series = three
    kept = choice.before_origins(series).groupBy("series_key").agg(F.max("agg_date").alias("last")).collect()
    assert {r.series_key: r["last"] for r in kept} == {
        key: day("2024-01-01") + dt.timedelta(days=39) for key in ("weekly", "rising")
    }


def test_no_series(spark):
    empty = series_of(spark, [1.0]).limit(0)
    chosen = choice.choose(empty, last_value)
    assert chosen.count() == 0 and choice.run(empty, last_value, chosen).count() == 0
