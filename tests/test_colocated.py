"""Merchants and merchant-days bucketed alike."""

import datetime as dt

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from merchantlens import schemas
from merchantlens.functions.dates import Period
from merchantlens.operators import kpis
from merchantlens.operators.filters import Filters
from merchantlens.plans import load
from merchantlens.sources import writers

PERIOD = Period.of("2024-01-01", "2024-02-15")


@pytest.fixture
def house(spark, tmp_path):
    house = load.Warehouse(str(tmp_path))
    number = F.col("id")
    merchants = spark.range(40).select(
        F.concat(F.lit("m"), number).alias("merchant_id"),
        F.concat(F.lit("Merchant_"), number).alias("merchant_name"),
        F.when(number % 3 == 0, "SaaS").otherwise("Travel").alias("business_category"),
        F.lit("SMB").alias("business_size"),
        F.lit(dt.date(2022, 1, 1)).alias("onboarding_date"),
    )
    days = spark.range(40 * 60).select(
        F.date_add(F.lit(dt.date(2024, 1, 1)), (number % 60).cast("int")).alias("agg_date"),
        F.concat(F.lit("m"), (number / 60).cast("int")).alias("merchant_id"),
        *[F.lit(1.5).alias(n) for n in ("gross_revenue", "net_revenue")],
        *[F.lit(2).cast("long").alias(n) for n in kpis.COUNTS],
        *[F.lit(0.5).alias(n) for n in ("avg_transaction_value", "processing_fees", "refund_total")],
    )
    assert days.columns == schemas.DAILY_AGGREGATES.names
    writers.replace_table(merchants, house.path("merchants"))
    writers.materialize_daily(days, house.path("daily_aggregates"))
    return house


def test_the_join_moves_no_row(spark, house):
    names = load.colocate(spark, house.root, 4, prefix="layout")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        merchants, daily = (spark.table(name) for name in names)
        for chosen in (Filters(PERIOD), Filters(PERIOD, "SaaS"), Filters(PERIOD, None, "Merchant_7")):
            report = kpis.report_rows(daily, merchants, chosen)
            assert "SortMergeJoin" in plan(report) and "Exchange" not in plan(report)
            plain = kpis.report_rows(house.table(spark, "daily_aggregates"), house.table(spark, "merchants"), chosen)
            assert "Exchange" in plan(plain)
            assert rows(report) == rows(plain) and report.count() > 0
            for of in (kpis.headline, kpis.period_compare):
                assert plan(of(daily, merchants, chosen)).count("Exchange hashpartitioning(merchant_id") == 0
                assert rows(of(daily, merchants, chosen)) == rows(
                    of(house.table(spark, "daily_aggregates"), house.table(spark, "merchants"), chosen)
                )
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        for name in names:
            spark.sql(f"DROP TABLE {name}")
