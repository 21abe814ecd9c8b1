"""I7 by I8: each series is forecast by the model with the smaller error on its own past.

Errors are taken at rolling origins.  An origin leaves out the latest rows of a series; both
models forecast the first ``horizon`` rows left out from the 30 rows before them.  All
origins of all series are forecast in one pass: an origin becomes a series of its own, of
at most 30 known rows and ``horizon`` held-out ones, whatever the length of the history.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, functions as F

from merchantlens.functions import rules
from merchantlens.operators import features, forecast, learning
from merchantlens.operators.features import PLATFORM, TARGET
from merchantlens.operators.learning import Score
from merchantlens.session import cut_lineage

ORIGINS, STEP, AHEAD = 3, 10, 10
BASELINE, MODEL = "baseline", "model"


def _left_out(origin: Column, step: int, horizon: int) -> Column:
    return origin * step + horizon


def oldest_left_out(origins: int = ORIGINS, step: int = STEP, horizon: int = AHEAD) -> int:
    """How many of the latest rows a model must not have been trained on."""
    return (origins - 1) * step + horizon


def at_origins(
    series: DataFrame, origins: int = ORIGINS, step: int = STEP, horizon: int = AHEAD
) -> tuple[DataFrame, DataFrame]:
    """(known, held): the rows before each origin and the ``horizon`` after it.

    ``series_key`` is ``origin:series_key``; held rows have ``series``, ``step`` (from 1).
    """
    recent = forecast.last_rows(series, oldest_left_out(origins, step, horizon) + rules.HISTORY)
    origin = F.explode(F.sequence(F.lit(0), F.lit(origins - 1))).alias("origin")
    each = recent.select("*", origin).withColumn("before", F.col("age") - _left_out(F.col("origin"), step, horizon))
    each = each.where((F.col("before") <= rules.HISTORY) & (F.col("before") > -horizon)).withColumns(
        {"series": F.col("series_key"), "series_key": F.concat(F.col("origin").cast("string"), F.lit(":"), "series_key")}
    )
    each = cut_lineage(each)
    known = each.where(F.col("before") > 0).select("series_key", "agg_date", TARGET)
    held = each.where(F.col("before") <= 0)
    return known, held.select("series", "series_key", TARGET, (1 - F.col("before")).alias("step"))


def _errors(known: DataFrame, held: DataFrame, predicted: DataFrame, name: str) -> DataFrame:
    """(series, days, mape) of one model."""
    last = known.groupBy("series_key").agg(F.max("agg_date").alias("last_date"))
    steps = predicted.join(last, "series_key").select(
        "series_key", "predicted_revenue", F.datediff("target_date", "last_date").alias("step")
    )
    error = F.abs(F.try_divide(F.col(TARGET) - F.col("predicted_revenue"), F.col(TARGET)))
    return held.join(steps, ["series_key", "step"]).groupBy("series").agg(
        F.count(error).alias(f"days_{name}"), F.avg(error).alias(f"mape_{name}")
    )


def choose(
    series: DataFrame,
    model: PipelineModel | Score,
    origins: int = ORIGINS,
    step: int = STEP,
    horizon: int = AHEAD,
    name: str = rules.GBT_NAME,
) -> DataFrame:
    """The errors of both models for each series, and the ``model_name`` of the better one.

    Ties go to the baseline.  A series too short to score the model has the baseline; one
    too short to score the baseline alone has the model.
    """
    known, held = at_origins(series, origins, step, horizon)
    plain = forecast.baseline(known, horizon)
    learned = learning.recursive(known, model, horizon, name=name)
    scored = _errors(known, held, plain, BASELINE).join(
        _errors(known, held, learned, MODEL), "series", "full"
    )
    every = series.select(F.col("series_key").alias("series")).distinct().join(scored, "series", "left")
    mine, other = F.col(f"mape_{MODEL}"), F.col(f"mape_{BASELINE}")
    better = mine.isNotNull() & (other.isNull() | (mine < other))
    return every.select(
        F.col("series").alias("series_key"),
        F.coalesce(f"days_{BASELINE}", F.lit(0)).alias(f"days_{BASELINE}"),
        F.coalesce(f"days_{MODEL}", F.lit(0)).alias(f"days_{MODEL}"),
        f"mape_{BASELINE}",
        f"mape_{MODEL}",
        F.when(better, F.lit(name)).otherwise(F.lit(rules.BASELINE_NAME)).alias("model_name"),
    )


def run(
    series: DataFrame,
    model: PipelineModel | Score,
    choice: DataFrame,
    horizon: int = rules.HORIZON,
    level: str = PLATFORM,
    name: str = rules.GBT_NAME,
) -> DataFrame:
    """Each series forecast by the model that ``choice`` names for it."""
    named = choice.select("series_key", "model_name")
    recent = cut_lineage(forecast.last_rows(series, rules.HISTORY).drop("age").join(named, "series_key"))

    def of(model_name: str) -> DataFrame:
        return recent.where(F.col("model_name") == model_name).drop("model_name")

    learned = learning.recursive(of(name), model, horizon, level, name=name)
    return learned.unionByName(forecast.baseline(of(rules.BASELINE_NAME), horizon, level))


def before_origins(series: DataFrame, origins: int = ORIGINS, step: int = STEP, horizon: int = AHEAD) -> DataFrame:
    """The training frame of a model that is to be scored at these origins."""
    aged = forecast.aged(series)
    known = aged.where(F.col("age") > oldest_left_out(origins, step, horizon)).drop("age")
    return features.build(known)
