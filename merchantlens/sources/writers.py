"""Sinks and their layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from merchantlens import schemas
from merchantlens.functions import dates
from merchantlens.operators.features import CATEGORY, MERCHANT, PLATFORM


def observed(df: DataFrame, metrics: Observation | None) -> DataFrame:
    """``df``, counted by ``metrics`` (row_count) while it is written.

    To be put right before the write: below a range partitioning the sampling would count too.
    """
    return df if metrics is None else df.observe(metrics, F.count(F.lit(1)).alias("row_count"))


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, metrics: Observation | None = None) -> None:
    observed(df, metrics).write.mode("overwrite").parquet(path)


def store_transactions(
    txns: DataFrame, path: str, mode: str = "overwrite", metrics: Observation | None = None
) -> None:
    """Transactions in month folders, each file holding a merchant range.

    Month folders prune by date and the files' min/max by merchant.  Range bounds are
    sampled and go on by date, so a hot month or merchant is split over several files.
    """
    laid_out = (
        txns.withColumn("txn_month", dates.month_start(F.col("transaction_date")))
        .repartitionByRange("txn_month", "merchant_id", "transaction_date")
        .sortWithinPartitions("txn_month", "merchant_id", "transaction_date")
    )
    observed(laid_out, metrics).write.mode(mode).partitionBy("txn_month").parquet(path)


def materialize_daily(
    daily: DataFrame, path: str, mode: str = "overwrite", metrics: Observation | None = None
) -> None:
    """Merchant-day rows in month folders, each file holding a merchant range.

    Month folders prune by date and the files' min/max by merchant.  Range
    bounds are sampled, hence even; a merchant has at most 31 rows a month.
    """
    observed(_daily_layout(daily), metrics).write.mode(mode).partitionBy("agg_month").parquet(path)


def _daily_layout(daily: DataFrame) -> DataFrame:
    return (
        daily.withColumn("agg_month", dates.month_start(F.col("agg_date")))
        .repartitionByRange("agg_month", "merchant_id")
        .sortWithinPartitions("agg_month", "merchant_id", "agg_date")
    )


def refresh_daily(daily: DataFrame, path: str) -> None:
    """Replace the month folders that ``daily`` has rows of, whole months; other folders stay.

    What is written lies beside the table until the job commits, so a job that is lost and
    run again gives the same table.
    """
    out = _daily_layout(daily).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("agg_month").parquet(path)


def write_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """A CSV folder with headers, without the ``drop`` columns."""
    df.drop(*drop).write.mode("overwrite").option("header", True).csv(path)


def write_importance(importance: DataFrame, path: str) -> None:
    """Ten rows, one per model input, in descending order."""
    names = [field.name for field in schemas.FEATURE_IMPORTANCE]
    ordered = importance.select(*names).orderBy(F.desc("importance"), "feature")
    ordered.write.mode("overwrite").option("header", True).csv(path)


def with_forecast_id(forecasts: DataFrame) -> DataFrame:
    """A serial id rising with (series, date) in a level; unique, gaps allowed.

    Rows are range-sorted and numbered inside their partitions: a global
    ``row_number`` would draw every merchant's forecast through one task.  Each level
    counts from a start of its own, so that levels stored one by one share no id.
    """
    key = ("forecast_level", "series_key", "target_date")
    levels = F.array(*[F.lit(level) for level in (PLATFORM, CATEGORY, MERCHANT)])
    first = (F.array_position(levels, F.col("forecast_level")) - 1) * F.lit(1 << 61)
    return (
        forecasts.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .withColumn("forecast_id", first + F.monotonically_increasing_id() + F.lit(1))
        .select(*[field.name for field in schemas.FORECASTS])
    )


def write_forecasts(forecasts: DataFrame, path: str, level: str = PLATFORM) -> None:
    """Replace the forecasts of ``level``, which all rows must have; other levels stay."""
    replace_table(with_forecast_id(forecasts), f"{path}/forecast_level={level}")


def colocate(df: DataFrame, table: str, path: str, buckets: int, *then: str, by: str = "merchant_id") -> None:
    """A catalog table in ``buckets`` sorted files by merchant.

    Tables with equally many buckets meet without a shuffle (C1).  ``then`` are further
    sort keys.  A merchant has a row a day at most, so no bucket is hot.
    """
    laid_out = df.repartition(buckets, by).sortWithinPartitions(by, *then)
    writer = laid_out.write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, by).sortBy(by, *then).saveAsTable(table)
