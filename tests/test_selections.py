"""Figures of a selection kept between calls (A13), and the watch job."""

import pytest
from helpers import rows
from test_gate import files, job  # noqa: F401

from merchantlens.functions.dates import Period
from merchantlens.operators.filters import Filters
from merchantlens.plans import dashboard, load, selections

CHOSEN = Filters(Period.of("2024-05-01", "2024-06-30"))


@pytest.fixture
def house(spark, files):  # noqa: F811
    load.load(spark, str(files / "m.csv"), str(files / "t.csv"), str(files / "house"))
    return load.Warehouse(str(files / "house"))


def test_a_second_question_reads_the_kept_figures(spark, house, files):  # noqa: F811
    asked = spark.createDataFrame([("Which method?",), ("Any refunds?",), ("Hello",)], "text string")
    tables = [house.table(spark, name) for name in ("daily_aggregates", "transactions", "merchants")]
    expected = rows(dashboard.ask(asked, *tables, CHOSEN))
    for _ in range(2):
        assert rows(selections.ask(spark, house.root, asked, CHOSEN)) == expected
    kept = selections.facts(spark, house.root, CHOSEN)
    assert all("/selections/" in name for df in kept for name in df.inputFiles())
    before = rows(kept[0])
    other = selections.facts(spark, house.root, Filters(CHOSEN.period, "Travel"))
    assert rows(other[0]) != before
    load.append(spark, str(files / "more.csv"), house.root)
    after = selections.facts(spark, house.root, CHOSEN)
    assert rows(after[0]) != before and rows(after[0])[0][1] > before[0][1]


def test_tables_without_a_mark_are_read(spark, house, files):  # noqa: F811
    (files / "house" / "transactions" / "_SUCCESS").unlink()
    headline, _ = selections.facts(spark, house.root, CHOSEN)
    assert not any("/selections/" in name for name in headline.inputFiles())


def test_watch_job(spark, house, files):  # noqa: F811
    out = files / "out"
    job(spark, "watch", house.root, "--out", out)
    read = {p.name: spark.read.csv(str(p), header=True) for p in out.iterdir()}
    assert set(read) == {
        "refund_alerts", "revenue_anomalies", "payment_mix_anomalies", "size_bands", "seasonal_factors", "category_days",
    }
    assert read["size_bands"].count() == 3 and read["category_days"].count() == 150
    assert read["seasonal_factors"].where("kind = 'weekday'").count() == 7
