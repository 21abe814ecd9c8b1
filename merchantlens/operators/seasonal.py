"""K3: trend and seasons of daily series, estimated from the series themselves.

The model is a product: volume = trend x weekday x day of month x month x the rest.

* The trend is the least-squares line over the days since the first one of the series, so
  growth comes out of the data.
* The weekday factor is the mean ratio of a day to the mean of the ``WEEK`` rows around it.
* The day-of-month factor is the same after the weekday factor is taken out, over ``MONTH`` rows.
* The month factor is the mean ratio of what is left to the trend.

Factors are scaled so that those of a kind have mean 1 in a series.  Rows are counted, not
days (S8): put ``features.date_spine`` in front where days are missing.  All windows
partition by the series, of which each has a row a day, so they share one shuffle.

A series shorter than a window has no ratios for its kind, whose factors are then 1; a
constant trend (one day) is the mean.  Null values count as no observation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from merchantlens.functions import dates

#: Rows of the centred means: a week, and five weeks, odd so that a day is in the middle.
WEEK, MONTH = 7, 35
DAYS_A_YEAR = 365.0
KINDS = ("weekday", "day_of_month", "month")


def decompose(
    days: DataFrame, series: str = "business_category", value: str = "total_transactions", day: str = "agg_date"
) -> DataFrame:
    """``days`` with trend, factors, the index they make, what was observed and the rest.

    ``expected_index`` is the product of the factors, ``observed_index`` the value over its
    trend, ``irregular`` the one over the other; ``annual_growth`` is the trend's rise in a
    year over the mean of the series.
    """
    whole = Window.partitionBy(series)
    ordered = whole.orderBy(day)
    y = F.col(value).cast("double")

    def centred(of: str, rows: int) -> Column:
        around = ordered.rowsBetween(-(rows // 2), rows // 2)
        return F.when(F.count(of).over(around) == rows, F.avg(of).over(around))

    def factor(df: DataFrame, kind: str, ratio: Column) -> DataFrame:
        """The mean ratio of each level of a kind, over the mean of the levels."""
        level, name = Window.partitionBy(series, kind), f"{kind}_factor"
        first = F.row_number().over(level.orderBy(day)) == 1
        df = df.withColumn("_ratio", ratio).withColumn("_mean", F.avg("_ratio").over(level))
        df = df.withColumn("_of_level", F.when(first, F.col("_mean")))
        scaled = F.try_divide(F.col("_mean"), F.avg("_of_level").over(whole))
        return df.withColumn(name, F.coalesce(scaled, F.lit(1.0))).drop("_ratio", "_mean", "_of_level")

    df = days.withColumns(
        {
            "_y": y,
            "_t": F.datediff(day, F.min(day).over(whole)).cast("double"),
            "weekday": dates.day_of_week(F.col(day)),
            "day_of_month": F.dayofmonth(day),
            "month": F.month(day),
        }
    )
    mean = F.avg("_y").over(whole)
    slope = F.coalesce(F.regr_slope("_y", "_t").over(whole), F.lit(0.0))
    df = df.withColumns({"_slope": slope, "_level": mean, "_middle": F.avg(F.when(y.isNotNull(), F.col("_t"))).over(whole)})
    df = df.withColumn("trend", F.col("_level") + F.col("_slope") * (F.col("_t") - F.col("_middle")))
    df = factor(df, "weekday", F.try_divide(F.col("_y"), centred("_y", WEEK)))
    df = df.withColumn("_week_out", F.try_divide(F.col("_y"), F.col("weekday_factor")))
    df = factor(df, "day_of_month", F.try_divide(F.col("_week_out"), centred("_week_out", MONTH)))
    left = F.try_divide(F.col("_week_out"), F.col("day_of_month_factor"))
    df = factor(df, "month", F.try_divide(left, F.col("trend")))
    expected = F.col("weekday_factor") * F.col("day_of_month_factor") * F.col("month_factor")
    df = df.withColumns({"expected_index": expected, "observed_index": F.try_divide(F.col("_y"), F.col("trend"))})
    return df.select(
        series,
        day,
        value,
        "trend",
        *[f"{kind}_factor" for kind in KINDS],
        "expected_index",
        "observed_index",
        F.try_divide(F.col("observed_index"), F.col("expected_index")).alias("irregular"),
        F.try_divide(F.col("_slope") * DAYS_A_YEAR, F.col("_level")).alias("annual_growth"),
    )


def factors(decomposed: DataFrame, series: str = "business_category", day: str = "agg_date") -> DataFrame:
    """(series, kind, level, factor, days): the table of factors, a row for each level of a kind."""
    levels = {"weekday": dates.day_of_week(F.col(day)), "day_of_month": F.dayofmonth(day), "month": F.month(day)}
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), levels[k].alias("level"), F.col(f"{k}_factor").alias("factor"))
            for k in KINDS
        ]
    )
    rows = decomposed.select(series, F.explode(entries).alias("e")).select(series, "e.*")
    return rows.groupBy(series, "kind", "level").agg(
        F.min("factor").alias("factor"), F.count(F.lit(1)).alias("days")
    )
