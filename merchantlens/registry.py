"""The named queries over the star-schema tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from merchantlens import schemas
from merchantlens.functions import dates, rules
from merchantlens.functions.dates import Period
from merchantlens.operators import (
    choice,
    enrich,
    features,
    filters as flt,
    forecast,
    gate,
    insights,
    kpis,
    learning,
    quality,
    seasonal,
    segments,
)
from merchantlens.operators.filters import Filters
from merchantlens.plans import load
from merchantlens.session import cut_lineage, scratch_path
from merchantlens.sources import readers, sql, star, writers

Query = Callable[[SparkSession, str], DataFrame]

# Parameters the queries share with the SQL texts.
PERIOD = Period.of("2000-10-01", "2000-12-31")
LAST_QUARTER = Period.of("2001-05-01", "2001-08-01")
CATEGORY = "BUILDING"
MERCHANT_NAME = "Customer#000001443"
NO_ROWS = Period.of("2030-01-01", "2030-01-31")
EVENTS = (
    rules.Event(date(1997, 5, 12), "Gateway outage", volume_mult=0.2),
    rules.Event(date(1999, 7, 15), "Viral event", volume_mult=3.0),
    rules.Event(date(1998, 8, 5), "High failure rate", payment_method="UPI", success_prob=0.60),
    rules.Event(date(2000, 1, 5), "High refund day", refund_prob=0.15),
)
INTENTS = (("payment", ("ouè", "méthode")), ("refund", ("ment",)), ("forecast", ("the",)))
TOTAL_BANDS = (("Enterprise", 15.0), ("Mid-Market", 10.0))
BASE_VOLUME = 10
# No decimal fractions: predictions must not lie exactly halfway between two cents.
WEIGHTS = {
    "revenue_lag_1": 2 / 7,
    "revenue_lag_7": 1 / 7,
    "revenue_lag_14": 1 / 11,
    "revenue_lag_30": 1 / 13,
    "rolling_avg_7d": 3 / 17,
    "rolling_avg_30d": 3 / 19,
    "day_of_week": 10.0,
    "day_of_month": -5.0,
    "month": 2.0,
    "is_weekend": -100.0,
}

_QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    """Register ``build`` under its own name, with its dates as text.

    Dates leave the engine as ``yyyy-MM-dd`` (H4), the form reports use.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build(spark, sf_dir)
        return df.withColumns(
            {
                field.name: F.date_format(field.name, "yyyy-MM-dd")
                for field in df.schema
                if isinstance(field.dataType, T.DateType)
            }
        )

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    _QUERIES[build.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.measures(star.transactions(spark, sf_dir))


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Averages depend on the order of addition beyond these digits."""
    return df.withColumns({name: F.round(name, digits) for name in names})


# --- Load, quality, row rules ------------------------------------------------


@query
def settlements(spark, sf_dir):
    """K1, K2"""
    return star.transactions(spark, sf_dir).select(
        "transaction_id",
        "payment_method",
        "payment_status",
        *[
            F.col(c).cast("double").alias(c)
            for c in (
                "transaction_amount",
                "processing_fee",
                "refund_amount",
                "settlement_amount",
            )
        ],
    )


@query
def row_counts(spark, sf_dir):
    """A6"""
    txns = star.transactions(spark, sf_dir)
    return quality.row_counts(
        {
            "merchants": star.merchants(spark, sf_dir),
            "transactions": txns,
            "daily_aggregates": kpis.daily_kpis(txns),
        }
    )


def _in_good_standing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = star.customers(spark, sf_dir).where("c_acctbal >= 0")
    return customers.selectExpr("c_custkey AS merchant_id")


@query
def orphan_transactions(spark, sf_dir):
    """C3"""
    found = quality.orphans(star.raw_transactions(spark, sf_dir), star.merchants(spark, sf_dir))
    return found.select("transaction_id", "merchant_id")


@query
def orphan_merchants(spark, sf_dir):
    """C3 by merchant"""
    return quality.orphan_merchants(
        star.raw_transactions(spark, sf_dir), star.merchants(spark, sf_dir)
    )


@query
def transactions_out_of_standing(spark, sf_dir):
    """C3, against a selection: the merchants in good standing"""
    known = _in_good_standing(spark, sf_dir)
    found = quality.orphans(star.raw_transactions(spark, sf_dir), known)
    return found.select("transaction_id", "merchant_id")


@query
def merchants_out_of_standing(spark, sf_dir):
    """C3 by merchant, against the same selection"""
    known = _in_good_standing(spark, sf_dir)
    return quality.orphan_merchants(star.raw_transactions(spark, sf_dir), known)


@query
def duplicate_keys(spark, sf_dir):
    """C4, on merchant and day, which are no key of the transactions"""
    txns = star.raw_transactions(spark, sf_dir)
    days = txns.select("merchant_id", F.to_date("transaction_date").alias("agg_date"))
    return quality.duplicate_keys(days, "merchant_id", "agg_date")


@query
def duplicate_transactions(spark, sf_dir):
    """C4, on the transaction key"""
    return quality.duplicate_keys(star.raw_transactions(spark, sf_dir), "transaction_id")


def _faulty_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with repeated rows and ids, and rows without an id or a merchant."""
    raw = star.raw_transactions(spark, sf_dir)
    number = F.col("transaction_id")
    dearer = (F.col("transaction_amount") + 1).cast(schemas.MONEY)
    nothing = F.lit(None)
    return (
        raw.unionByName(raw.where(number % 75 == 0))
        .unionByName(raw.where(number % 50 == 0).withColumn("transaction_amount", dearer))
        .unionByName(raw.where(number % 125 == 0).withColumn("payment_method", nothing.cast("string")))
        .unionByName(raw.where(number % 301 == 0).withColumn("transaction_id", nothing.cast("long")))
        .unionByName(
            raw.where(number % 302 == 0)
            .withColumn("transaction_id", -number)
            .withColumn("merchant_id", nothing.cast("long"))
        )
    )


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = _in_good_standing(spark, sf_dir)
    return gate.gate(_faulty_transactions(spark, sf_dir), "transaction_id", "merchant_id", known)


_PLAIN = {"transaction_date": F.to_date, "transaction_amount": lambda c: F.col(c).cast("double")}


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumns({name: change(name) for name, change in _PLAIN.items()})


@query
def loaded_accepted(spark, sf_dir):
    """C3, C4 at load: the rows that keep the constraints, stored and read back"""
    path = scratch_path(spark, "accepted")
    accepted, _ = _gated(spark, sf_dir)
    writers.store_transactions(accepted, path)
    return _plain(readers.read_table(spark, path).drop("txn_month"))


@query
def loaded_rejected(spark, sf_dir):
    """C3, C4 at load: the rows that do not, with the reason and how many are equal"""
    return _plain(_gated(spark, sf_dir)[1])


@query
def null_rates(spark, sf_dir):
    """K7"""
    return quality.null_rates(star.raw_transactions(spark, sf_dir))


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seasonal.decompose(kpis.segment_days(_frame(spark, sf_dir), star.merchants(spark, sf_dir)))


@query
def seasonal_index(spark, sf_dir):
    """K3: the seasonal multipliers of every category-day that traded, and what was observed"""
    found = _decomposed(spark, sf_dir).select(
        "business_category",
        "agg_date",
        "total_transactions",
        F.col("weekday_factor").alias("weekly_mult"),
        F.col("day_of_month_factor").alias("monthly_mult"),
        F.col("month_factor").alias("festive_mult"),
        "expected_index",
        "observed_index",
    )
    return _rounded(found, 6, "weekly_mult", "monthly_mult", "festive_mult", "expected_index", "observed_index")


@query
def seasonal_decomposition(spark, sf_dir):
    """K3: the trend with its growth, and what neither trend nor seasons explain"""
    found = _decomposed(spark, sf_dir).select(
        "business_category", "agg_date", "total_transactions", "trend", "irregular", "annual_growth"
    )
    return _rounded(found, 6, "trend", "irregular", "annual_growth")


@query
def seasonal_factors(spark, sf_dir):
    """K3: the factor of each weekday, day of the month and month"""
    return _rounded(seasonal.factors(_decomposed(spark, sf_dir)), 6, "factor")


@query
def event_effect(spark, sf_dir):
    """K4"""
    return enrich.event_effect(_frame(spark, sf_dir), EVENTS)


# --- Filters -----------------------------------------------------------------


@query
def category_options(spark, sf_dir):
    """B5"""
    return flt.categories(star.merchants(spark, sf_dir))


@query
def merchant_options(spark, sf_dir):
    """B6"""
    return flt.merchant_names(star.merchants(spark, sf_dir))


@query
def merchants_in_category(spark, sf_dir):
    """B7"""
    return flt.merchants_of(star.merchants(spark, sf_dir), CATEGORY)


@query
def filtered_daily(spark, sf_dir):
    """B2, B4, C1"""
    daily = kpis.daily_kpis(star.transactions(spark, sf_dir))
    return kpis.filtered_daily(daily, star.merchants(spark, sf_dir), Filters(PERIOD, CATEGORY))


@query
def export_report(spark, sf_dir):
    """A11"""
    daily = kpis.daily_kpis(star.transactions(spark, sf_dir))
    return kpis.report_rows(daily, star.merchants(spark, sf_dir), Filters(PERIOD))


# --- KPIs --------------------------------------------------------------------


@query
def daily_kpis(spark, sf_dir):
    """D1"""
    return kpis.daily_kpis(star.transactions(spark, sf_dir))


@query
def platform_trend(spark, sf_dir):
    """D2"""
    return kpis.platform_trend(_frame(spark, sf_dir))


@query
def daily_status_rates(spark, sf_dir):
    """D5"""
    return kpis.daily_rates(_frame(spark, sf_dir))


@query
def headline_kpis(spark, sf_dir):
    """D6"""
    return kpis.headline(
        _frame(spark, sf_dir), star.merchants(spark, sf_dir), Filters(PERIOD, CATEGORY)
    )


@query
def period_compare(spark, sf_dir):
    """D7, J5"""
    return kpis.period_compare(
        _frame(spark, sf_dir), star.merchants(spark, sf_dir), Filters(PERIOD)
    )


@query
def kpi_cards(spark, sf_dir):
    """H14"""
    compared = kpis.period_compare(
        _frame(spark, sf_dir), star.merchants(spark, sf_dir), Filters(PERIOD)
    )
    return kpis.cards(compared)


@query
def revenue_series(spark, sf_dir):
    """D8"""
    return kpis.revenue_series(
        _frame(spark, sf_dir), star.merchants(spark, sf_dir), Filters(PERIOD, CATEGORY)
    )


# --- Segments ----------------------------------------------------------------


@query
def revenue_by_category(spark, sf_dir):
    """D3"""
    return segments.by_category(_frame(spark, sf_dir), star.merchants(spark, sf_dir))


@query
def top_categories(spark, sf_dir):
    """D9, all categories"""
    return segments.top_segments(
        _frame(spark, sf_dir), star.merchants(spark, sf_dir), Filters(PERIOD)
    )


@query
def top_merchants_in_category(spark, sf_dir):
    """D9, one category"""
    return segments.top_segments(
        _frame(spark, sf_dir), star.merchants(spark, sf_dir), Filters(PERIOD, CATEGORY)
    )


@query
def payment_distribution(spark, sf_dir):
    """D4"""
    return segments.payment_distribution(star.transactions(spark, sf_dir))


@query
def payment_mix(spark, sf_dir):
    """D10"""
    return segments.payment_mix(star.transactions(spark, sf_dir), PERIOD)


@query
def payment_mix_in_category(spark, sf_dir):
    """D10 with the optional filters and the last day"""
    return segments.payment_mix(
        star.transactions(spark, sf_dir),
        PERIOD,
        include_end=True,
        merchants=star.merchants(spark, sf_dir),
        chosen=Filters(PERIOD, CATEGORY),
    )


@query
def top_payment_method(spark, sf_dir):
    """D13"""
    return insights.top_method(segments.payment_mix(star.transactions(spark, sf_dir), PERIOD))


@query
def merchant_size_band(spark, sf_dir):
    """K6, by whole volume"""
    return segments.size_band(_frame(spark, sf_dir), TOTAL_BANDS, per_day=False)


# --- Series and features -----------------------------------------------------


def _category_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.daily_series(
        _frame(spark, sf_dir), features.CATEGORY, star.merchants(spark, sf_dir)
    )


@query
def daily_series_platform(spark, sf_dir):
    """D11"""
    return features.daily_series(_frame(spark, sf_dir))


@query
def daily_series_category(spark, sf_dir):
    """D11"""
    return _category_series(spark, sf_dir)


@query
def daily_series_merchant(spark, sf_dir):
    """D11"""
    return features.daily_series(_frame(spark, sf_dir), features.MERCHANT)


@query
def date_spine(spark, sf_dir):
    """K5"""
    return features.date_spine(_category_series(spark, sf_dir))


@query
def date_spine_merchant(spark, sf_dir):
    """K5 for every merchant, active in the period or not"""
    series = features.daily_series(_frame(spark, sf_dir), features.MERCHANT)
    keys = star.merchants(spark, sf_dir).select(F.col("merchant_id").cast("string").alias("series_key"))
    return features.date_spine(series, PERIOD, keys)


@query
def lag_features(spark, sf_dir):
    """E1"""
    return features.lags(_category_series(spark, sf_dir))


@query
def rolling_features(spark, sf_dir):
    """E2"""
    means = features.rolling_means(_category_series(spark, sf_dir))
    return _rounded(means, 4, "rolling_avg_7d", "rolling_avg_30d")


@query
def feature_frame(spark, sf_dir):
    """E3, on days without gaps"""
    frame = features.build(features.date_spine(_category_series(spark, sf_dir)))
    return _rounded(frame, 4, "rolling_avg_7d", "rolling_avg_30d")


# --- Forecasts ---------------------------------------------------------------


@query
def future_dates(spark, sf_dir):
    """I2"""
    return forecast.future_dates(_category_series(spark, sf_dir))


def _rounded_forecast(df: DataFrame) -> DataFrame:
    return _rounded(df, 4, "predicted_revenue", "confidence_lower", "confidence_upper")


@query
def baseline_forecast(spark, sf_dir):
    """I4, I6"""
    series = _category_series(spark, sf_dir)
    return _rounded_forecast(forecast.baseline(series, level=features.CATEGORY))


@query
def forecast_window(spark, sf_dir):
    """B10"""
    series = features.daily_series(_frame(spark, sf_dir))
    shown = forecast.window(forecast.baseline(series, horizon=90), LAST_QUARTER, days=14)
    return _rounded_forecast(shown)


@query
def forecast_overlay(spark, sf_dir):
    """G1"""
    frame, merchants = _frame(spark, sf_dir), star.merchants(spark, sf_dir)
    actual = kpis.revenue_series(frame, merchants, Filters(LAST_QUARTER))
    predicted = forecast.baseline(features.daily_series(frame))
    shown = forecast.overlay(actual, forecast.window(predicted, LAST_QUARTER))
    return _rounded(shown, 4, "revenue", "lower", "upper")


@query
def baseline_backtest(spark, sf_dir):
    """I8"""
    return _rounded(forecast.backtest(_category_series(spark, sf_dir)), 6, "mape")


@query
def stored_forecasts(spark, sf_dir):
    """The forecast table written, numbered and read back"""
    path = scratch_path(spark, "forecasts")
    series = features.daily_series(_frame(spark, sf_dir), features.MERCHANT)
    writers.write_forecasts(
        forecast.baseline(series, horizon=7, level=features.MERCHANT), path, features.MERCHANT
    )
    stored = readers.read_table(spark, path)
    ids = stored.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("predicted_revenue").alias("predicted"),
        F.count_distinct("forecast_id").alias("distinct_ids"),
        F.min("target_date").alias("first_day"),
        F.max("target_date").alias("last_day"),
    )
    return ids


@query
def stored_forecast_levels(spark, sf_dir):
    """Two levels stored one after the other, with the place of each row by its id"""
    path = scratch_path(spark, "forecasts")
    by_level = {
        features.CATEGORY: _category_series(spark, sf_dir),
        features.PLATFORM: features.daily_series(_frame(spark, sf_dir)),
    }
    for level, series in by_level.items():
        writers.write_forecasts(forecast.baseline(series, level=level), path, level)
    stored = readers.read_table(spark, path, schemas.FORECASTS)
    place = F.row_number().over(Window.partitionBy("series_key").orderBy("forecast_id"))
    return _rounded_forecast(stored.withColumn("place", place).drop("forecast_id"))


def _correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's correlation with revenue, as its importance."""
    frame = features.build(features.date_spine(_category_series(spark, sf_dir)))
    weights = frame.agg(
        *[
            F.abs(F.corr(F.col(name).cast("double"), features.TARGET)).alias(name)
            for name in features.FEATURES
        ]
    )
    pairs = ", ".join(f"'{name}', {name}" for name in features.FEATURES)
    return weights.selectExpr(
        f"stack({len(features.FEATURES)}, {pairs}) AS (feature, importance)"
    )


@query
def importance_labelled(spark, sf_dir):
    """C2, D12, F4"""
    return _rounded(forecast.label_features(_correlations(spark, sf_dir)), 4, "impact")


@query
def importance_csv(spark, sf_dir):
    """A10: importances written as CSV, read back and labelled"""
    path = scratch_path(spark, "importance")
    writers.write_importance(_correlations(spark, sf_dir), path)
    stored = readers.read_importance(spark, path)
    return _rounded(forecast.label_features(stored), 4, "impact")


@query
def next_day_inputs(spark, sf_dir):
    """E5, E6, on the short histories of single merchants"""
    series = features.daily_series(_frame(spark, sf_dir), features.MERCHANT)
    return _rounded(learning.next_inputs(series), 6, "rolling_avg_7d", "rolling_avg_30d")


@query
def next_day_inputs_category(spark, sf_dir):
    """E5, E6, on histories of more than 30 days"""
    inputs = learning.next_inputs(_category_series(spark, sf_dir))
    return _rounded(inputs, 6, "rolling_avg_7d", "rolling_avg_30d")


def _linear(inputs: dict[str, Column]) -> Column:
    """A fixed score in place of a trained one, which SQL can repeat."""
    return sum((inputs[name] * F.lit(weight) for name, weight in WEIGHTS.items()), F.lit(0.0))


def _linear_forecast(series: DataFrame, level: str) -> DataFrame:
    found = learning.recursive(series, _linear, level=level, name="Linear")
    return _rounded(found, 2, "predicted_revenue", "confidence_lower", "confidence_upper")


@query
def linear_forecast(spark, sf_dir):
    """G2, I3, on histories of more than 30 days"""
    return _linear_forecast(_category_series(spark, sf_dir), features.CATEGORY)


@query
def linear_forecast_merchant(spark, sf_dir):
    """G2, I3, on short histories that grow"""
    series = features.daily_series(_frame(spark, sf_dir), features.MERCHANT)
    return _linear_forecast(series, features.MERCHANT)


@query
def model_choice(spark, sf_dir):
    """The errors of the linear score and the baseline at rolling origins, and the better one"""
    found = choice.choose(_category_series(spark, sf_dir), _linear, name="Linear")
    return _rounded(found, 6, "mape_baseline", "mape_model")


@query
def chosen_forecast(spark, sf_dir):
    """Each merchant forecast by its better model, on short histories"""
    series = cut_lineage(features.daily_series(_frame(spark, sf_dir), features.MERCHANT))
    chosen = cut_lineage(choice.choose(series, _linear, origins=2, step=3, horizon=3, name="Linear"))
    found = choice.run(series, _linear, chosen, 7, features.MERCHANT, name="Linear")
    return _rounded(found, 2, "predicted_revenue", "confidence_lower", "confidence_upper")


@query
def gbt_forecast(spark, sf_dir):
    """I1, I3, I6, I7"""
    series = cut_lineage(_category_series(spark, sf_dir))
    model = learning.train(features.build(series))
    return learning.run(series, model, level=features.CATEGORY)


@query
def gbt_importance(spark, sf_dir):
    """I5, C2"""
    series = cut_lineage(features.daily_series(_frame(spark, sf_dir)))
    model = learning.train(features.build(series))
    return forecast.label_features(learning.importance(model, spark))


@query
def gbt_backtest(spark, sf_dir):
    """I8, for the trees"""
    return learning.backtest(_category_series(spark, sf_dir))


# --- Alerts and answers ------------------------------------------------------


@query
def refund_alerts(spark, sf_dir):
    """J1, by month"""
    frame = _frame(spark, sf_dir).withColumn("month", dates.month_start(F.col("agg_date")))
    return insights.refund_alerts(frame, "month")


@query
def question_intents(spark, sf_dir):
    """J3"""
    routed = insights.route(star.questions(spark, sf_dir), INTENTS)
    return routed.select("conv_id", "turn", "intent")


@query
def question_answers(spark, sf_dir):
    """J2, J4"""
    txns = star.transactions(spark, sf_dir)
    headline = kpis.headline(
        kpis.measures(txns), star.merchants(spark, sf_dir), Filters(PERIOD)
    )
    top = insights.top_method(segments.payment_mix(txns, PERIOD))
    routed = insights.route(star.questions(spark, sf_dir), INTENTS)
    return insights.answers(routed, headline, top).drop("text")


@query
def question_answers_empty(spark, sf_dir):
    """J2, J4 over a period without rows"""
    txns = star.transactions(spark, sf_dir)
    headline = kpis.headline(kpis.measures(txns), star.merchants(spark, sf_dir), Filters(NO_ROWS))
    top = insights.top_method(segments.payment_mix(txns, NO_ROWS))
    routed = insights.route(star.questions(spark, sf_dir), INTENTS)
    return insights.answers(routed, headline, top).drop("text")


@query
def headline_merchant(spark, sf_dir):
    """D6, B4 by merchant name"""
    chosen = Filters(PERIOD, merchant=MERCHANT_NAME)
    return kpis.headline(_frame(spark, sf_dir), star.merchants(spark, sf_dir), chosen)


@query
def revenue_series_merchant(spark, sf_dir):
    """D8, B4 by merchant name"""
    chosen = Filters(PERIOD, merchant=MERCHANT_NAME)
    return kpis.revenue_series(_frame(spark, sf_dir), star.merchants(spark, sf_dir), chosen)


@query
def revenue_anomalies(spark, sf_dir):
    """N1"""
    days = kpis.segment_days(_frame(spark, sf_dir), star.merchants(spark, sf_dir))
    series = days.select(
        F.col("business_category").alias("series_key"),
        "agg_date",
        F.col("net_revenue").cast("double").alias("net_revenue"),
        "failure_rate",
        "refund_rate",
    )
    found = insights.anomalies(series)
    return _rounded(found, 6, "z_net_revenue", "z_failure_rate", "z_refund_rate")


def _mix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame(spark, sf_dir).withColumn("series_key", F.lit(features.PLATFORM))


@query
def payment_mix_anomalies(spark, sf_dir):
    """Days whose payment methods depart from those of the rows before"""
    found = insights.payment_mix_anomalies(_mix_counts(spark, sf_dir))
    return _rounded(found, 6, "chi_square", "z_mix", "psi")


@query
def payment_mix_anomalies_category(spark, sf_dir):
    """N1 for payment methods, in each category"""
    keys = ["agg_date", "payment_method"]
    frame, merchants = _frame(spark, sf_dir), star.merchants(spark, sf_dir)
    counts = kpis.with_merchant(frame, merchants, "business_category", keys=keys)
    counts = counts.withColumnRenamed("business_category", "series_key")
    return _rounded(insights.payment_mix_anomalies(counts), 6, "chi_square", "z_mix", "psi")


@query
def headline_sql(spark, sf_dir):
    """The headline figures of a merchant, asked in SQL"""
    chosen = Filters(PERIOD, merchant=MERCHANT_NAME)
    daily = kpis.daily_kpis(star.transactions(spark, sf_dir))
    return sql.selected(sql.HEADLINE, daily, star.merchants(spark, sf_dir), chosen)


@query
def revenue_series_sql(spark, sf_dir):
    """The revenue of a category, asked in SQL"""
    daily = kpis.daily_kpis(star.transactions(spark, sf_dir))
    return sql.selected(sql.SERIES, daily, star.merchants(spark, sf_dir), Filters(PERIOD, CATEGORY))


# --- Sources and sinks -------------------------------------------------------


@query
def stored_daily(spark, sf_dir):
    """The merchant-day table stored by month, then a period of it"""
    path = scratch_path(spark, "daily_aggregates")
    writers.materialize_daily(kpis.daily_kpis(star.transactions(spark, sf_dir)), path)
    stored = readers.read_table(spark, path)
    return kpis.platform_trend(flt.date_range(stored, PERIOD))


@query
def appended_transactions(spark, sf_dir):
    """A3, A4: a table replaced by the first loads and appended by the rest"""
    path = scratch_path(spark, "appended")
    txns = star.transactions(spark, sf_dir)
    early = F.col("transaction_date") < dates.timestamp_literal(PERIOD.start)
    writers.replace_table(txns.where(early), path)
    writers.append_table(txns.where(~early), path)
    return kpis.platform_trend(kpis.measures(readers.read_table(spark, path)))


@query
def stored_transactions(spark, sf_dir):
    """Transactions stored by month, then the payment mix of a period"""
    path = scratch_path(spark, "transactions")
    writers.store_transactions(star.transactions(spark, sf_dir), path)
    return segments.payment_mix(readers.read_table(spark, path), PERIOD)


@query
def refreshed_daily(spark, sf_dir):
    """A3, A5: the merchant-day table after an append, of whose months alone it is computed again"""
    house = load.Warehouse(scratch_path(spark, "refreshed"))
    declared = [F.col(field.name).cast(field.dataType) for field in schemas.TRANSACTIONS]
    txns = star.transactions(spark, sf_dir).select(*declared)
    late = F.col("transaction_date") >= dates.timestamp_literal(LAST_QUARTER.start)
    added = late & (F.xxhash64("transaction_id") % 3 != 0)
    writers.store_transactions(txns.where(~added), house.path("transactions"))
    stored = house.table(spark, "transactions")
    writers.materialize_daily(kpis.daily_kpis(stored), house.path("daily_aggregates"))
    writers.store_transactions(txns.where(added), house.path("transactions"), "append")
    load.refresh(spark, house.root, load.months_of(txns.where(added)))
    return house.table(spark, "daily_aggregates").drop("agg_month")


@query
def csv_transactions(spark, sf_dir):
    """Transactions written as CSV, read back under the schema"""
    path = scratch_path(spark, "transactions-csv")
    names = [field.name for field in schemas.TRANSACTIONS]
    writers.write_csv(star.transactions(spark, sf_dir).select(*names), path)
    return kpis.daily_kpis(readers.read_transactions(spark, path))


@query
def csv_merchants(spark, sf_dir):
    """Merchants written as CSV without an internal column, read back"""
    path = scratch_path(spark, "merchants-csv")
    number = F.col("merchant_id")
    onboarded = F.date_add(F.lit("2022-01-01").cast("date"), (number % 365).cast("int"))
    internal = star.merchants(spark, sf_dir).withColumns(
        {"onboarding_date": F.when(number % 7 != 0, onboarded), "base_daily_volume": F.lit(BASE_VOLUME)}
    )
    writers.write_csv(internal, path, drop=("base_daily_volume",))
    return readers.read_merchants(spark, path)
