"""Boosted-tree forecasting.

Series of different levels of revenue can share one model: ``scaled`` training divides
the target, the lags and the means by the series' own mean of 30 rows, a stage of the
stored pipeline, and predictions are multiplied by it again.  A small series then counts
as much as a large one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from merchantlens import schemas
from merchantlens.functions import rules
from merchantlens.operators import features, forecast
from merchantlens.operators.features import FEATURES, PLATFORM, TARGET
from merchantlens.session import cut_lineage
from merchantlens.sources.local import constant_table

MIN_ROWS = 31
#: The mean that revenues are divided by, and the inputs that are revenues.
LEVEL = "rolling_avg_30d"
REVENUES = tuple(name for name in FEATURES if name.startswith(("revenue_lag_", "rolling_avg_")))

#: From the model inputs of a day, by name, to its revenue.
Score = Callable[[dict[str, Column]], Column]


def train(
    frame: DataFrame,
    trees: int = 100,
    depth: int = 5,
    rate: float = 0.1,
    seed: int = 42,
    max_bins: int = 32,
    scaled: bool = False,
) -> PipelineModel:
    """Boosted trees over all series of the feature frame, ``scaled`` to a common level.

    The frame is written once first: every boosting round reads it again, and
    a lost executor must not recompute it from the transactions.  Rebalancing
    makes its files even, few for the platform and many for all merchants.
    """
    rows = cut_lineage(frame.select(TARGET, *FEATURES).hint("rebalance"))
    stages = [
        *([normaliser()] if scaled else []),
        VectorAssembler(inputCols=FEATURES, outputCol="features"),
        GBTRegressor(
            featuresCol="features",
            labelCol=TARGET,
            maxIter=trees,
            maxDepth=depth,
            stepSize=rate,
            seed=seed,
            maxBins=max_bins,
        ),
    ]
    return Pipeline(stages=stages).fit(rows)


def normaliser() -> SQLTransformer:
    """The pipeline stage that divides revenues by the mean of 30 rows; without one nothing changes."""
    kept = ", ".join(name for name in FEATURES if name not in REVENUES)
    divided = ", ".join(f"coalesce(try_divide({name}, {LEVEL}), {name}) AS {name}" for name in (TARGET, *REVENUES))
    return SQLTransformer(statement=f"SELECT {kept}, {divided} FROM __THIS__")


def is_scaled(model: PipelineModel) -> bool:
    return isinstance(model.stages[0], SQLTransformer)


def importance(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """One row per model input, ten in all."""
    trees: GBTRegressionModel = model.stages[-1]
    weights = trees.featureImportances.toArray()
    rows = [(name, float(weight)) for name, weight in zip(FEATURES, weights)]
    return constant_table(spark, rows, schemas.FEATURE_IMPORTANCE).orderBy(
        F.desc("importance"), "feature"
    )


def history(series: DataFrame) -> DataFrame:
    """The last 30 values of each series, oldest first, in one bounded row."""
    entry = F.struct("agg_date", TARGET)
    return (
        forecast.last_rows(series, rules.HISTORY)
        .groupBy("series_key")
        .agg(F.max("agg_date").alias("last_date"), F.sort_array(F.collect_list(entry)).alias("h"))
        .select("series_key", "last_date", F.col(f"h.{TARGET}").alias("h"))
    )


def _back(values: Column, k: int) -> Column:
    """E5: k-th value from the end, or the last one of a shorter history."""
    return F.when(F.size(values) >= k, F.element_at(values, -k)).otherwise(
        F.element_at(values, -1)
    )


def _mean_back(values: Column, n: int) -> Column:
    """Mean of up to ``n`` last values, nulls left out."""
    length = F.least(F.size(values), F.lit(n))
    kept = F.filter(F.slice(values, -length, length), lambda x: x.isNotNull())
    added = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.try_divide(added, F.size(kept).cast("double"))


def _push(values: Column, value: Column) -> Column:
    """Append, keeping the last 30."""
    longer = F.concat(values, F.array(value))
    return F.when(F.size(values) < rules.HISTORY, longer).otherwise(
        F.slice(longer, 2, rules.HISTORY)
    )


def step_inputs(values: Column, day: Column) -> dict[str, Column]:
    """Model inputs of ``day`` from the values before it."""
    inputs = features.calendar(day)
    inputs.update({f"revenue_lag_{k}": _back(values, k) for k in rules.LAGS})
    inputs.update({f"rolling_avg_{n}d": _mean_back(values, n) for n in rules.ROLLING})
    return {name: inputs[name] for name in FEATURES}


def start(series: DataFrame) -> DataFrame:
    """The state before the first step: next day and history of each series."""
    return history(series).select(
        "series_key", F.date_add("last_date", 1).alias("target_date"), "h"
    )


def next_inputs(series: DataFrame) -> DataFrame:
    """What the model sees of each series' first day to come."""
    inputs = step_inputs(F.col("h"), F.col("target_date"))
    return start(series).withColumns(inputs).drop("h")


def recursive(
    series: DataFrame,
    model: PipelineModel | Score,
    horizon: int = rules.HORIZON,
    level: str = PLATFORM,
    cut_every: int = 5,
    name: str = rules.GBT_NAME,
) -> DataFrame:
    """Predict a day, append it to the history, predict the next.

    ``model`` is a trained one or a function of the model inputs.

    All series advance together; a step is a narrow map over one row per series
    and shuffles nothing.  The state is written out every ``cut_every`` steps,
    which bounds both the plan and what a lost executor costs, and after the
    last, so that no later filter is pushed down through the chain of steps.
    """
    values, day = F.col("h"), F.col("target_date")
    inputs = {key: value.cast("double") for key, value in step_inputs(values, day).items()}
    scale = F.lit(1.0)
    if isinstance(model, PipelineModel) and is_scaled(model):
        scale = F.coalesce(F.nullif(inputs[LEVEL], F.lit(0.0)), F.lit(1.0))
    vector = array_to_vector(F.array(*[v / scale if k in REVENUES else v for k, v in inputs.items()]))

    def predicted(rows: DataFrame) -> DataFrame:
        if isinstance(model, PipelineModel):
            found = model.stages[-1].transform(rows.select("*", vector.alias("features"), scale.alias("scale")))
            return found.withColumn("prediction", F.col("prediction") * F.col("scale"))
        return rows.select("*", model(inputs).alias("prediction"))

    value = F.greatest(F.col("prediction"), F.lit(0.0))
    advanced = (
        F.col("series_key"),
        F.date_add(day, 1).alias("target_date"),
        _push(values, value).alias("h"),
        F.concat("predicted", F.array(value)).alias("predicted"),
    )
    nothing = F.array().cast("array<double>")
    state = cut_lineage(start(series).withColumn("predicted", nothing))
    for step in range(1, horizon + 1):
        state = predicted(state).select(*advanced)
        if step % cut_every == 0 or step == horizon:
            state = cut_lineage(state)
    days = state.select(
        "series_key",
        F.col("target_date").alias("end"),
        F.posexplode("predicted").alias("pos", "predicted_revenue"),
    ).withColumn("target_date", F.date_add(F.col("end"), F.col("pos") - horizon))
    return forecast.with_band(days, level, name, rules.GBT_BAND)


def run(
    series: DataFrame,
    model: PipelineModel | None,
    horizon: int = rules.HORIZON,
    level: str = PLATFORM,
    cut_every: int = 5,
    least_rows: int = MIN_ROWS,
) -> DataFrame:
    """Trees for series of ``least_rows`` rows or more, the baseline elsewhere or without
    a model; ``model_name`` says which."""
    if model is None:
        return forecast.baseline(series, horizon, level)
    length = F.count(F.lit(1)).over(Window.partitionBy("series_key"))
    sized = series.withColumn("_rows", length)
    enough = sized.where(F.col("_rows") >= least_rows).drop("_rows")
    short = sized.where(F.col("_rows") < least_rows).drop("_rows")
    return recursive(enough, model, horizon, level, cut_every).unionByName(
        forecast.baseline(short, horizon, level)
    )


def backtest(
    series: DataFrame, holdout: int = rules.HORIZON, cut_every: int = 5, **training
) -> DataFrame:
    """I8 for the trees: trained before the last ``holdout`` rows, scored on them.

    Predictions are matched with the held-out rows by position, since the
    features count rows as well.
    """
    aged = cut_lineage(forecast.aged(series))
    known = aged.where(F.col("age") > holdout).drop("age")
    model = train(features.build(known), **training)
    predicted = recursive(known, model, holdout, cut_every=cut_every)
    last = known.groupBy("series_key").agg(F.max("agg_date").alias("last_date"))
    steps = predicted.join(last, "series_key").select(
        "series_key", "predicted_revenue", F.datediff("target_date", "last_date").alias("step")
    )
    actual = aged.where(F.col("age") <= holdout).select(
        "series_key", TARGET, (F.lit(holdout + 1) - F.col("age")).alias("step")
    )
    return forecast.mape(actual.join(steps, ["series_key", "step"]), TARGET, "predicted_revenue")
