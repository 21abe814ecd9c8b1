"""The jobs from CSV files to answers."""

import datetime as dt
import shutil

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from merchantlens import __main__ as command, schemas
from merchantlens.functions.dates import Period
from merchantlens.operators import enrich, kpis
from merchantlens.operators.filters import Filters
from merchantlens.plans import dashboard, explore, forecasting, load
from merchantlens.sources import readers, writers

DAYS = 70
PERIOD = Period.of("2024-11-01", "2024-12-09")


@pytest.fixture(scope="module")
def house(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("house")
    merchants = spark.createDataFrame(
        [(f"m{i}", f"Merchant_{i}", c, "SMB", dt.date(2022, 1, 1))
         for i, c in enumerate(("SaaS", "SaaS", "Travel"))],
        "merchant_id string, merchant_name string, business_category string, "
        "business_size string, onboarding_date date",
    )
    number = F.col("id")
    raw = spark.range(DAYS * 12).select(
        F.concat(F.lit("t"), number).alias("transaction_id"),
        F.concat(F.lit("m"), number % 3).alias("merchant_id"),
        F.expr("timestamp_ntz'2024-10-01 08:30:00' + make_dt_interval(CAST(id / 12 AS INT))").alias(
            "transaction_date"
        ),
        (100 + number % 17).cast("decimal(18,2)").alias("transaction_amount"),
        F.when(number % 50 != 0, F.when(number % 2 == 0, "UPI").otherwise("Wallet")).alias(
            "payment_method"
        ),
        F.when(number % 20 == 0, "Failed")
        .when(number % 20 == 1, "Refunded")
        .otherwise("Successful")
        .alias("payment_status"),
    )
    writers.write_csv(merchants, str(root / "m.csv"))
    writers.write_csv(enrich.settle(raw), str(root / "t.csv"))
    counts = load.load(spark, str(root / "m.csv"), str(root / "t.csv"), str(root / "tables"))
    return str(root / "tables"), rows(counts)


def test_load_counts(house):
    assert house[1] == [
        ("daily_aggregates", DAYS * 3),
        ("merchants", 3),
        ("merchants_rejected", 0),
        ("transactions", DAYS * 12),
        ("transactions_rejected", 0),
    ]


def test_checks_find_nothing(spark, house):
    checked = load.check(spark, house[0])
    rates = checked.pop("null_rates")
    assert {name: df.count() for name, df in checked.items()} == dict.fromkeys(checked, 0)
    assert rates.where("column_name = 'payment_method'").first().null_rate == pytest.approx(0.02, abs=0.01)


def test_explore_tables(spark, house):
    tables = load.Warehouse(house[0])
    daily, txns = tables.table(spark, "daily_aggregates"), tables.table(spark, "transactions")
    out = explore.explore(daily, txns, tables.table(spark, "merchants"))
    assert out["platform_revenue_trend"].count() == DAYS
    assert [r.business_category for r in out["revenue_by_category"].collect()] == ["SaaS", "Travel"]
    assert out["payment_methods"].agg(F.sum("count_share")).first()[0] == pytest.approx(100)
    sums = out["transaction_rates"].select(F.expr("success_rate + failure_rate + refund_rate"))
    assert {round(r[0], 9) for r in sums.collect()} == {100.0}


@pytest.fixture(scope="module")
def forecasts(spark, house):
    return forecasting.forecast(spark, house[0], horizon=7, trees=3, depth=2)


def test_forecast_job(spark, house, forecasts):
    got = forecasts.orderBy("target_date").collect()
    assert [r.target_date for r in got] == [
        dt.date(2024, 12, 10) + dt.timedelta(days=i) for i in range(7)
    ]
    assert {r.model_name for r in got} == {"GradientBoosting"}
    assert all(0 <= r.confidence_lower <= r.predicted_revenue <= r.confidence_upper for r in got)
    importance = readers.read_importance(spark, f"{house[0]}/feature_importance")
    assert importance.count() == 10


def test_forecast_job_by_category_without_trees(spark, house, tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(house[0], copy)
    got = forecasting.forecast(spark, copy, level="Category", horizon=3, use_trees=False)
    assert got.groupBy("series_key", "model_name").count().orderBy("series_key").collect() == [
        ("SaaS", "Baseline_EWMA", 3),
        ("Travel", "Baseline_EWMA", 3),
    ]


def test_levels_are_kept_apart(spark, house, forecasts, tmp_path):
    copy = str(tmp_path / "copy")
    shutil.copytree(house[0], copy)
    forecasting.forecast(spark, copy, level="Category", horizon=3, trees=2, depth=2)
    stored = load.Warehouse(copy).table(spark, "forecasts")
    assert rows(stored.groupBy("forecast_level").count()) == [("Category", 6), ("Platform", 7)]
    assert stored.select("forecast_id").distinct().count() == 13
    paths = [load.Warehouse(copy).importance_path(level) for level in ("Platform", "Category")]
    assert [readers.read_importance(spark, path).count() for path in paths] == [10, 10]


def test_stored_tables_have_declared_schemas(spark, house):
    tables = load.Warehouse(house[0])
    for name in ("merchants", "transactions", "daily_aggregates"):
        declared = schemas.TABLES[name].simpleString()
        assert tables.table(spark, name).schema.simpleString() == declared
        assert readers.read_table(spark, tables.path(name)).schema.simpleString() == declared


def test_dashboard_reads_its_selection_once(spark, house):
    tables = load.Warehouse(house[0])
    names = ("daily_aggregates", "transactions", "merchants")
    for chosen in (Filters(PERIOD), Filters(PERIOD, "SaaS"), Filters(PERIOD, None, "Merchant_2")):
        out = dashboard.dashboard(*[tables.table(spark, name) for name in names], chosen)
        for name in ("report", "comparison", "cards", "revenue", "segments"):
            assert "daily_aggregates" not in plan(out[name])
        kept = kpis.period_compare(tables.table(spark, names[0]), tables.table(spark, names[2]), chosen)
        assert rows(out["comparison"]) == rows(kept)
        assert "daily_aggregates" in plan(kept)


def test_dashboard_tables(spark, house, forecasts):
    tables = load.Warehouse(house[0])
    daily, txns = tables.table(spark, "daily_aggregates"), tables.table(spark, "transactions")
    merchants = tables.table(spark, "merchants")
    importance = readers.read_importance(spark, f"{house[0]}/feature_importance")
    chosen = Filters(Period.of("2024-11-01", "2024-12-09"))
    out = dashboard.dashboard(daily, txns, merchants, chosen, forecasts, importance)
    assert out["report"].count() == 39 * 3
    assert out["revenue"].groupBy("kind").count().orderBy("kind").collect() == [
        ("actual", 39),
        ("forecast", 7),
    ]
    assert out["drivers"].count() == 6
    assert out["cards"].first().payments == "468"
    narrow = Filters(chosen.period, "SaaS", "Merchant_1")
    out = dashboard.dashboard(daily, txns, merchants, narrow, forecasts)
    assert out["revenue"].columns == ["agg_date", "net_rev"]
    assert [r.segment for r in out["segments"].collect()] == ["Merchant_1"]
    lists = dashboard.options(merchants, "SaaS")
    assert rows(lists["merchants"]) == [("Merchant_0",), ("Merchant_1",)]


def test_ask(spark, house):
    tables = load.Warehouse(house[0])
    daily, txns = tables.table(spark, "daily_aggregates"), tables.table(spark, "transactions")
    chosen = Filters(Period.of("2024-11-01", "2024-12-09"))
    questions = spark.createDataFrame([("Which method is best?",), ("Any refunds?",)], "text string")
    got = dashboard.ask(questions, daily, txns, tables.table(spark, "merchants"), chosen)
    answers = {r.intent: r.answer for r in got.collect()}
    assert "most popular payment method" in answers["payment"]
    assert "refund rate is currently at **4.9%**" in answers["refund"]


def test_command_line(spark, house, forecasts, tmp_path, capsys):
    root, out = house[0], str(tmp_path / "out")
    cli = lambda *argv: command.run(spark, command.arguments(list(argv)))
    chosen = ("--start", "2024-11-01", "--end", "2024-12-09")
    cli("explore", root, "--out", out)
    cli("check", root, "--out", out)
    cli("dashboard", root, *chosen, "--out", out)
    header = {"header": True}
    assert spark.read.options(**header).csv(f"{out}/platform_revenue_trend").count() == DAYS
    assert spark.read.options(**header).csv(f"{out}/report").columns == [
        "agg_date",
        "net_revenue",
        "total_transactions",
    ]
    assert spark.read.options(**header).csv(f"{out}/drivers").count() == 6
    cli("ask", root, *chosen, "What does the future hold?")
    assert "Looking ahead 30 days" in capsys.readouterr().out


def test_missing_tables_are_none(spark, tmp_path):
    gone = str(tmp_path / "gone")
    assert readers.if_present(lambda: readers.read_table(spark, gone)) is None
    assert readers.if_present(lambda: readers.read_importance(spark, gone)) is None


def test_no_answer_is_lost(spark, house, tmp_path):
    asked = [f"question {n}" for n in range(25)]
    days = ["--start", "2024-10-01", "--end", "2024-11-30"]
    args = command.arguments(["ask", house[0], *days, "--out", str(tmp_path), *asked])
    command.run(spark, args)
    assert spark.read.csv(f"{tmp_path}/answers", header=True).count() == 25


def test_long_tables_are_not_printed_in_part(spark):
    with pytest.raises(SystemExit, match="--out"):
        command.deliver({"days": spark.range(command.SCREEN + 1)}, None)
