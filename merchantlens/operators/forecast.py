"""Forecast tables: baseline, future days, windows, overlay, accuracy
(B10, C2, E4, E7, G1, I2, I4, I6, I8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from merchantlens.functions import rules
from merchantlens.functions.dates import Period, day_literal
from merchantlens.operators import segments
from merchantlens.operators.features import PLATFORM, TARGET
from merchantlens.sources.local import constant_table

COLUMNS = (
    "target_date",
    "forecast_level",
    "series_key",
    "model_name",
    "predicted_revenue",
    "confidence_lower",
    "confidence_upper",
)


LABELS = T.StructType(
    [T.StructField("feature", T.StringType()), T.StructField("label", T.StringType())]
)


def aged(series: DataFrame) -> DataFrame:
    """Rows numbered back from the latest of their series, which has ``age`` 1."""
    latest = Window.partitionBy("series_key").orderBy(F.desc("agg_date"))
    return series.withColumn("age", F.row_number().over(latest))


def last_rows(series: DataFrame, rows: int) -> DataFrame:
    """The latest ``rows`` rows of each series, with their age.

    The rank limit is applied before the shuffle as well, so only that many
    rows of a series travel per task.
    """
    return aged(series).where(F.col("age") <= rows)


def horizon_days(last: Column, horizon: int) -> Column:
    return F.explode(F.sequence(F.date_add(last, 1), F.date_add(last, horizon)))


def future_dates(series: DataFrame, horizon: int = rules.HORIZON) -> DataFrame:
    """The days after the last one of each series."""
    last = series.groupBy("series_key").agg(F.max("agg_date").alias("last_date"))
    return last.select("series_key", horizon_days(F.col("last_date"), horizon).alias("target_date"))


def with_band(df: DataFrame, level: str, model_name: str, band: float) -> DataFrame:
    """A band of a fixed fraction around the prediction, as a forecast row."""
    value = F.col("predicted_revenue")
    return (
        df.withColumn("forecast_level", F.lit(level))
        .withColumn("model_name", F.lit(model_name))
        .withColumn("confidence_lower", value * F.lit(1.0 - band))
        .withColumn("confidence_upper", value * F.lit(1.0 + band))
        .select(*COLUMNS)
    )


def weekday_multiplier(day: Column) -> Column:
    weekend = F.weekday(day).isin(5, 6)
    return F.when(weekend, F.lit(rules.BASELINE_WEEKEND)).otherwise(F.lit(rules.BASELINE_WEEKDAY))


def trailing_mean(rows: int = rules.HISTORY) -> Column:
    """E4, as an aggregate over ``last_rows``: NULL with fewer values."""
    return F.when(F.count(TARGET) == rows, F.avg(TARGET))


def baseline(
    series: DataFrame,
    horizon: int = rules.HORIZON,
    level: str = PLATFORM,
    noise: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """I4: mean of the last 30 rows, scaled by weekday; not clamped.

    ``noise`` spreads each prediction evenly over plus or minus that fraction.
    """
    base = (
        last_rows(series, rules.HISTORY)
        .groupBy("series_key")
        .agg(F.max("agg_date").alias("last_date"), trailing_mean().alias("base"))
    )
    days = base.withColumn("target_date", horizon_days(F.col("last_date"), horizon))
    predicted = F.col("base") * weekday_multiplier(F.col("target_date"))
    if noise:
        predicted = predicted * (F.lit(1.0 - noise) + F.rand(seed) * F.lit(2.0 * noise))
    return with_band(
        days.withColumn("predicted_revenue", predicted),
        level,
        rules.BASELINE_NAME,
        rules.BASELINE_BAND,
    )


def window(forecasts: DataFrame, period: Period, days: int = rules.HORIZON) -> DataFrame:
    """Forecasts up to ``days`` after the period; no lower bound."""
    last = F.date_add(day_literal(period.end), days)
    return forecasts.where(F.col("target_date") <= last)


def overlay(actual: DataFrame, forecasts: DataFrame) -> DataFrame:
    """G1: actual and predicted revenue on one time axis.

    ``actual`` has ``agg_date`` and ``net_rev``.
    """
    past = actual.select(
        F.col("agg_date").alias("day"),
        F.lit("actual").alias("kind"),
        F.col("net_rev").alias("revenue"),
    )
    future = forecasts.select(
        F.col("target_date").alias("day"),
        F.lit("forecast").alias("kind"),
        F.col("predicted_revenue").alias("revenue"),
        F.col("confidence_lower").alias("lower"),
        F.col("confidence_upper").alias("upper"),
    )
    return past.unionByName(future, allowMissingColumns=True)


def mape(compared: DataFrame, actual: str, predicted: str) -> DataFrame:
    """I8: mean absolute percentage error by series; days of 0 cannot be scored."""
    error = F.abs(F.try_divide(F.col(actual) - F.col(predicted), F.col(actual)))
    return compared.groupBy("series_key").agg(
        F.count(error).cast("long").alias("scored_days"), F.avg(error).alias("mape")
    )


def backtest(series: DataFrame, holdout: int = rules.HORIZON) -> DataFrame:
    """I8 for the baseline: fitted before the last ``holdout`` rows, scored on them."""
    held = F.col("age") <= holdout
    fitted = F.when(~held, F.col(TARGET))
    whole = Window.partitionBy("series_key")
    base = F.when(F.count(fitted).over(whole) == rules.HISTORY, F.avg(fitted).over(whole))
    recent = last_rows(series, rules.HISTORY + holdout).withColumn("base", base)
    predicted = F.col("base") * weekday_multiplier(F.col("agg_date"))
    return mape(recent.where(held).withColumn("predicted", predicted), TARGET, "predicted")


def label_features(
    importance: DataFrame,
    labels: dict[str, str] = rules.FEATURE_LABELS,
    top: int = rules.TOP_FEATURES,
) -> DataFrame:
    """Importances in percent of all, with readable names.

    A feature without a label shows its own name (S20); the shares are taken
    over all features before the first ``top`` are kept (S21).
    """
    names = constant_table(importance.sparkSession, list(labels.items()), LABELS)
    shared = segments.with_shares(importance, impact="importance")
    return (
        shared.join(names, "feature", "left")
        .select("feature", F.coalesce("label", "feature").alias("feature_friendly"), "impact")
        .orderBy(F.desc("impact"), "feature")
        .limit(top)
    )
