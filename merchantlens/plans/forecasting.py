"""Forecast job: series, model, predictions and importances, all stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from merchantlens.functions import rules
from merchantlens.operators import choice, features, learning
from merchantlens.operators.forecast import baseline
from merchantlens.plans import tail
from merchantlens.plans.load import Warehouse
from merchantlens.session import cut_lineage
from merchantlens.sources import writers


def forecast(
    spark: SparkSession,
    root: str,
    level: str = features.PLATFORM,
    horizon: int = rules.HORIZON,
    use_trees: bool = True,
    by_error: bool = False,
    **training,
) -> DataFrame:
    """Replace the forecasts of a level, and its importances if trees were trained.

    The series is written once and then read by training and prediction both.
    ``use_trees=False`` asks for the baseline (I7), which reads the table of last rows alone.
    ``by_error`` gives each series the model with the smaller error at rolling origins (I8),
    where there are rows enough to train before them.
    """
    house = Warehouse(root)
    last = None if use_trees else tail.series(spark, house.path("series_tail"), level)
    if last is not None:
        found = baseline(last, horizon, level)
        writers.write_forecasts(found, house.path("forecasts"), level)
        return of_level(spark, house, level)
    merchants = house.table(spark, "merchants") if level == features.CATEGORY else None
    daily = house.table(spark, "daily_aggregates")
    series = cut_lineage(features.daily_series(daily, level, merchants))
    frame = features.build(series)
    model = None
    if use_trees and not frame.isEmpty():
        model = learning.train(frame, **training)
        writers.write_importance(learning.importance(model, spark), house.importance_path(level))
    before = choice.before_origins(series) if model is not None and by_error else None
    if before is not None and not before.isEmpty():
        # The errors are those of a model that has not seen the rows it is scored on.
        chosen = cut_lineage(choice.choose(series, learning.train(before, **training)))
        found = choice.run(series, model, chosen, horizon, level)
    else:
        found = learning.run(series, model, horizon, level)
    writers.write_forecasts(found, house.path("forecasts"), level)
    return of_level(spark, house, level)


def of_level(spark: SparkSession, house: Warehouse, level: str) -> DataFrame:
    stored = house.table(spark, "forecasts")
    return stored.where(stored.forecast_level == level)
