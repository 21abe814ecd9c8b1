"""Both join strategies, hot merchants, partition counts and plan shapes."""

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from merchantlens.functions.dates import Period
from merchantlens.operators import (
    enrich,
    features,
    filters as flt,
    forecast,
    insights,
    kpis,
    quality,
    segments,
)
from merchantlens.operators.filters import Filters
from merchantlens.session import MANY_MERCHANTS

DAYS = Period.of("2024-01-10", "2024-02-20")


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """6,000 transactions of 40 merchants; one of them holds a third of all."""
    root = tmp_path_factory.mktemp("skewed")
    number = F.col("id")
    raw = spark.range(6000).select(
        number.alias("transaction_id"),
        F.when(number % 3 == 0, 7).otherwise(number % 41).cast("long").alias("merchant_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 60 AS INT), 0, 0, id)").alias(
            "transaction_date"
        ),
        (10 + number % 97 + 0.25).cast("decimal(18,2)").alias("transaction_amount"),
        F.when(number % 2 == 0, "UPI").when(number % 11 != 0, "Credit Card").alias("payment_method"),
        F.when(number % 15 == 0, "Failed")
        .when(number % 15 == 1, "Refunded")
        .otherwise("Successful")
        .alias("payment_status"),
    )
    enrich.settle(raw).write.parquet(str(root / "txns"))
    spark.range(40).selectExpr(
        "id AS merchant_id",
        "concat('Merchant_', id % 30) AS merchant_name",
        "IF(id % 2 = 0, 'SaaS', 'Travel') AS business_category",
    ).write.parquet(str(root / "merchants"))
    return spark.read.parquet(str(root / "txns")), spark.read.parquet(str(root / "merchants"))


def answers(txns, merchants):
    frame = kpis.measures(txns)
    some = Filters(DAYS, "SaaS")
    return {
        "headline": rows(kpis.headline(frame, merchants, some)),
        "compare": rows(kpis.period_compare(frame, merchants, some)),
        "series": rows(kpis.revenue_series(frame, merchants, some)),
        "category": rows(segments.by_category(frame, merchants)),
        "top": rows(segments.top_segments(frame, merchants, some)),
        "days": rows(kpis.segment_days(frame, merchants)),
        "mix": rows(segments.payment_mix(txns, DAYS, True, merchants, some)),
        "orphans": rows(quality.orphans(txns, merchants)),
        "orphan_merchants": rows(quality.orphan_merchants(txns, merchants)),
        "daily": rows(features.daily_series(frame, "Category", merchants)),
    }


def with_conf(spark, found, **conf):
    before = {}
    for key, value in conf.items():
        name = key.replace("__", ".")
        before[name] = spark.conf.get(name)
        spark.conf.set(name, value)
    try:
        return found()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_a_selection_restricts_the_rows_before_they_are_summed(spark, stored):
    frame, merchants = kpis.measures(stored[0]), stored[1]
    one = Filters(DAYS, merchant="Merchant_7")

    def build():
        series = kpis.revenue_series(frame, merchants, one)
        return rows(series), plan(series)

    usual, _ = build()
    found, text = with_setting(spark, MANY_MERCHANTS, "true", build)
    assert found == usual and len(found) > 0
    steps = text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text
    assert "LeftSemi" in steps
    assert steps.index("LeftSemi") > steps.index("HashAggregate")  # below the sums


def with_setting(spark, name, value, found):
    spark.conf.set(name, value)
    try:
        return found()
    finally:
        spark.conf.unset(name)


def test_results_do_not_depend_on_join_or_partitions(spark, stored):
    small = answers(*stored)
    no_broadcast = {
        "spark__sql__autoBroadcastJoinThreshold": "-1",
        "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
        "spark__sql__shuffle__partitions": "7",
    }
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    large = with_conf(spark, lambda: answers(*stored), **no_broadcast)
    assert small == large
    many = with_setting(spark, MANY_MERCHANTS, "true", lambda: answers(*stored))
    assert small == many
    assert len(small["orphans"]) == small["orphan_merchants"][0][1] > 0


def test_sums_agree_with_the_transactions(stored):
    txns, _ = stored
    daily = kpis.daily_kpis(txns)
    sums = daily.agg(
        F.sum(F.col("net_revenue").cast("decimal(18,2)")),
        F.sum("total_transactions"),
        F.sum(F.expr("successful_transactions + failed_transactions + refunded_transactions")),
    ).first()
    raw = txns.agg(F.sum("settlement_amount"), F.count(F.lit(1))).first()
    assert (sums[0], sums[1], sums[2]) == (raw[0], raw[1], raw[1])
    assert rows(kpis.platform_trend(daily)) == rows(kpis.platform_trend(kpis.measures(txns)))


def test_period_reaches_the_scan(stored):
    txns, merchants = stored
    trend = plan(kpis.platform_trend(flt.date_range(kpis.measures(txns), DAYS)))
    assert "GreaterThanOrEqual(transaction_date,2024-01-10T00:00)" in trend
    mix = plan(segments.payment_mix(txns, DAYS))
    assert "GreaterThanOrEqual(transaction_date,2024-01-10T00:00)" in mix


def test_columns_are_pruned(stored):
    txns, merchants = stored
    text = plan(kpis.platform_trend(kpis.measures(txns)))
    assert (
        "ReadSchema: struct<transaction_date:timestamp_ntz,transaction_amount:decimal(18,2),"
        "payment_status:string>" in text
    )


def shuffles(df):
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    return final.count("Exchange hashpartitioning"), final


def test_small_merchants_leave_one_shuffle(stored):
    txns, merchants = stored
    series = features.daily_series(kpis.measures(txns), "Category", merchants)
    count, text = shuffles(series)
    assert count == 1 and "BroadcastHashJoin" in text and "CartesianProduct" not in text


def test_events_are_broadcast_constants(stored):
    effect = enrich.event_effect(kpis.measures(stored[0]))
    count, text = shuffles(effect)
    assert count == 1 and text.count("BroadcastHashJoin") == 2
    assert text.count("LocalTableScan") == 2


def test_shares_reuse_the_shuffle(stored):
    done = segments.payment_distribution(stored[0])
    done.collect()
    assert "ReusedExchange" in plan(done) and "Window" not in plan(done)


def test_spine_reads_the_data_once(stored):
    txns, merchants = stored
    spine = features.date_spine(features.daily_series(kpis.measures(txns), "Category", merchants))
    spine.collect()
    assert "ReusedExchange" in plan(spine)
    assert spine.count() == 2 * 60


def test_last_rows_limit_before_the_shuffle(stored):
    txns, _ = stored
    series = features.daily_series(kpis.measures(txns), "Merchant")
    assert plan(forecast.baseline(series)).count("WindowGroupLimit") == 2


def test_features_share_one_sort(stored):
    txns, merchants = stored
    series = features.daily_series(kpis.measures(txns), "Category", merchants)
    text = plan(features.build(series))
    assert text.count("Sort [series_key") == 1
    assert "SinglePartition" not in text


def test_no_python_or_cross_join_in_plans(stored):
    txns, merchants = stored
    frame = kpis.measures(txns)
    headline = kpis.headline(frame, merchants, Filters(DAYS))
    top = insights.top_method(segments.payment_mix(txns, DAYS))
    routed = insights.route(txns.selectExpr("payment_method AS text"))
    for df in (
        insights.answers(routed, headline, top),
        features.date_spine(features.daily_series(frame)),
        forecast.baseline(features.daily_series(frame)),
        quality.null_rates(txns),
    ):
        text = plan(df)
        for word in ("Cartesian", "NestedLoop", "Python", "Pandas"):
            assert word not in text
