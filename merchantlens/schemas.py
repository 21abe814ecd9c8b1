"""Declared schemas of the data model; nothing is ever inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


MERCHANTS = _struct(
    ("merchant_id", T.StringType()),
    ("merchant_name", T.StringType()),
    ("business_category", T.StringType()),
    ("business_size", T.StringType()),
    ("onboarding_date", T.DateType()),
)

TRANSACTIONS = _struct(
    ("transaction_id", T.StringType()),
    ("merchant_id", T.StringType()),
    ("transaction_date", T.TimestampNTZType()),
    ("transaction_amount", MONEY),
    ("payment_method", T.StringType()),
    ("payment_status", T.StringType()),
    ("processing_fee", MONEY),
    ("refund_amount", MONEY),
    ("settlement_amount", MONEY),
)

DAILY_AGGREGATES = _struct(
    ("agg_date", T.DateType()),
    ("merchant_id", T.StringType()),
    ("gross_revenue", T.DoubleType()),
    ("net_revenue", T.DoubleType()),
    ("total_transactions", T.LongType()),
    ("successful_transactions", T.LongType()),
    ("failed_transactions", T.LongType()),
    ("refunded_transactions", T.LongType()),
    ("avg_transaction_value", T.DoubleType()),
    ("processing_fees", T.DoubleType()),
    ("refund_total", T.DoubleType()),
)

FORECASTS = _struct(
    ("forecast_id", T.LongType()),
    ("target_date", T.DateType()),
    ("forecast_level", T.StringType()),
    ("series_key", T.StringType()),
    ("model_name", T.StringType()),
    ("predicted_revenue", T.DoubleType()),
    ("confidence_lower", T.DoubleType()),
    ("confidence_upper", T.DoubleType()),
)

FEATURE_IMPORTANCE = _struct(
    ("feature", T.StringType()),
    ("importance", T.DoubleType()),
)

#: Stored tables by name, with the columns that their folders hold.
TABLES = {
    "merchants": MERCHANTS,
    "transactions": T.StructType([*TRANSACTIONS, T.StructField("txn_month", T.DateType())]),
    "daily_aggregates": T.StructType([*DAILY_AGGREGATES, T.StructField("agg_month", T.DateType())]),
    "forecasts": FORECASTS,
}
