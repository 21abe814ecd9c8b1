import datetime as dt

import pytest
from helpers import day, series_of
from pyspark.ml.linalg import Vectors

from merchantlens.operators import features, forecast, learning


@pytest.fixture(scope="module")
def wave(spark):
    values = [100 + 10 * (i % 7) + (i % 31) for i in range(120)]
    return series_of(spark, values, key="long").union(
        series_of(spark, [5.0 * v for v in values[:90]], key="mid")
    )


@pytest.fixture(scope="module")
def model(wave):
    return learning.train(features.build(wave), trees=5, depth=3)


def by_hand(model, history, last, horizon):
    """The recursion in plain Python, one prediction at a time."""
    values, out = list(history), []
    for step in range(1, horizon + 1):
        when = last + dt.timedelta(days=step)

        def back(k):
            return values[-k] if len(values) >= k else values[-1]

        row = [when.weekday(), when.day, when.month, int(when.weekday() >= 5)]
        row += [back(k) for k in (1, 7, 14, 30)]
        row += [sum(values[-n:]) / len(values[-n:]) for n in (7, 30)]
        out.append(max(0.0, model.stages[-1].predict(Vectors.dense(row))))
        values.append(out[-1])
    return out


@pytest.mark.parametrize("cut_every", [4, 10])
def test_recursive_I3_against_plain_recursion(wave, model, cut_every):
    got = learning.recursive(wave, model, horizon=12, cut_every=cut_every).collect()
    for key in ("long", "mid"):
        past = wave.where(f"series_key = '{key}'").orderBy("agg_date").collect()
        expected = by_hand(model, [r.net_revenue for r in past], past[-1].agg_date, 12)
        mine = sorted((r for r in got if r.series_key == key), key=lambda r: r.target_date)
        assert [r.predicted_revenue for r in mine] == pytest.approx(expected)
        assert mine[0].target_date == past[-1].agg_date + dt.timedelta(days=1)
        assert mine[-1].target_date == past[-1].agg_date + dt.timedelta(days=12)
        for r in mine:
            assert r.confidence_lower == pytest.approx(0.85 * r.predicted_revenue)
            assert r.confidence_upper == pytest.approx(1.15 * r.predicted_revenue)


def test_short_history_S12(spark, model):
    short = series_of(spark, [50.0, 60.0, 70.0])
    got = learning.recursive(short, model, horizon=9).orderBy("target_date").collect()
    expected = by_hand(model, [50.0, 60.0, 70.0], day("2024-01-03"), 9)
    assert [r.predicted_revenue for r in got] == pytest.approx(expected)


def test_predictions_are_clamped_S13(spark):
    falling = series_of(spark, [-10.0 - i for i in range(80)])
    model = learning.train(features.build(falling), trees=5, depth=3)
    got = learning.recursive(falling, model, horizon=5).collect()
    assert {r.predicted_revenue for r in got} == {0.0}
    assert {r.confidence_lower for r in got} == {0.0}


def test_run_falls_back_I7(spark, wave, model):
    mixed = wave.union(series_of(spark, range(30), key="short"))
    names = {
        (r.series_key, r.model_name)
        for r in learning.run(mixed, model, horizon=2).select("series_key", "model_name").collect()
    }
    assert names == {
        ("long", "GradientBoosting"),
        ("mid", "GradientBoosting"),
        ("short", "Baseline_EWMA"),
    }
    assert {r.model_name for r in learning.run(mixed, None, horizon=2).collect()} == {"Baseline_EWMA"}


def test_importance_I5(spark, model):
    got = [tuple(r) for r in learning.importance(model, spark).collect()]
    assert {name for name, _ in got} == set(features.FEATURES)
    weights = [w for _, w in got]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)
    assert forecast.label_features(learning.importance(model, spark)).count() == 6


def test_backtest_of_trees_I8(wave):
    got = {r.series_key: r for r in learning.backtest(wave, holdout=10, trees=5, depth=3).collect()}
    assert {r.scored_days for r in got.values()} == {10}
    assert all(0 <= r.mape < 1 for r in got.values())


def test_scaled_trees_serve_every_level_of_revenue(spark):
    weekly = [90.0, 95.0, 100.0, 105.0, 110.0, 140.0, 60.0]
    series = None
    for key, size in (("small", 1.0), ("middle", 1e3), ("large", 1e7)):
        values = [size * weekly[n % 7] * (1 + 0.03 * ((n * 7919) % 5 - 2)) for n in range(150)]
        one = series_of(spark, values, key=key)
        series = one if series is None else series.unionByName(one)
    training = {"trees": 15, "depth": 4}
    errors = {
        scaled: {r.series_key: r.mape for r in learning.backtest(series, 14, scaled=scaled, **training).collect()}
        for scaled in (False, True)
    }
    assert max(errors[True].values()) < 0.15 < errors[False]["small"]
    assert all(errors[True][key] <= errors[False][key] + 0.02 for key in errors[True])


def test_a_series_without_revenue_is_scaled_by_one(spark):
    values = [0.0] * 80 + [10.0 * (n % 3) for n in range(60)]
    known = series_of(spark, values, key="a").unionByName(series_of(spark, [0.0] * 60, key="none"))
    model = learning.train(features.build(known), trees=2, depth=2, scaled=True)
    assert learning.is_scaled(model) and learning.importance(model, spark).count() == 10
    got = learning.recursive(known, model, 3).where("series_key = 'none'").collect()
    assert len(got) == 3 and all(r.predicted_revenue >= 0 for r in got)
