"""The last rows of every series, kept next to the merchant-days.

A forecast by the baseline, and the state that a recursive forecast starts from, need the
last 30 rows of a series only.  This table holds them, so neither reads the history.  Each
change writes a new version beside the old one; readers take the newest that is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantlens.functions import rules
from merchantlens.operators import features, forecast
from merchantlens.operators.features import TARGET

LEVELS = (features.PLATFORM, features.CATEGORY, features.MERCHANT)
COLUMNS = ("forecast_level", "series_key", "agg_date", TARGET)
SCHEMA = f"forecast_level string, series_key string, agg_date date, {TARGET} double"


def every_series(daily: DataFrame, merchants: DataFrame) -> DataFrame:
    """The daily series of all levels, told apart by ``forecast_level``."""
    found = None
    for level in LEVELS:
        series = features.daily_series(daily, level, merchants).withColumn("forecast_level", F.lit(level))
        series = series.select(*COLUMNS)
        found = series if found is None else found.unionByName(series)
    return found


def _last(rows: DataFrame) -> DataFrame:
    """The last rows of each series of each level."""
    keyed = rows.withColumns({"_key": F.col("series_key"), "series_key": F.concat("forecast_level", F.lit(":"), "series_key")})
    kept = forecast.last_rows(keyed, rules.HISTORY).withColumn("series_key", F.col("_key"))
    return kept.select(*COLUMNS)


def merged(tail: DataFrame, days: DataFrame) -> DataFrame:
    """``tail`` with newer or corrected ``days`` in place of its own.

    Right as long as days only come in or change: a day that is taken away would let an
    older one, which the tail does not have, move up.
    """
    own = tail.withColumn("_new", F.lit(0)).unionByName(days.select(*COLUMNS).withColumn("_new", F.lit(1)))
    value = F.max_by(TARGET, "_new").alias(TARGET)
    return _last(own.groupBy("forecast_level", "series_key", "agg_date").agg(value))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions below a folder, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not store.exists(folder):
        return []
    names = [status.getPath().getName() for status in store.listStatus(folder)]
    numbers = sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version="))
    done = spark._jvm.org.apache.hadoop.fs.Path
    return [n for n in numbers if store.exists(done(f"{path}/version={n}/_SUCCESS"))]


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version; None before the first."""
    versions = _versions(spark, path)
    return spark.read.schema(SCHEMA).parquet(f"{path}/version={versions[-1]}") if versions else None


def _write(rows: DataFrame, path: str) -> None:
    number = (_versions(rows.sparkSession, path) or [0])[-1] + 1
    # What a lost run has left of this number is replaced.
    rows.repartitionByRange("forecast_level", "series_key").write.mode("overwrite").parquet(f"{path}/version={number}")


def rebuild(daily: DataFrame, merchants: DataFrame, path: str) -> None:
    """The table from the whole history."""
    _write(_last(every_series(daily, merchants)), path)


def update(days: DataFrame, merchants: DataFrame, path: str) -> None:
    """The table with the merchant-days of some whole months, computed again, put in."""
    spark = days.sparkSession
    tail = read(spark, path)
    if tail is None:
        raise ValueError("there is no table of last rows yet")
    _write(merged(tail, every_series(days, merchants)), path)


def series(spark: SparkSession, path: str, level: str) -> DataFrame | None:
    """The last rows of the series of a level, as forecasts take them."""
    tail = read(spark, path)
    return None if tail is None else tail.where(F.col("forecast_level") == level).drop("forecast_level")
