"""SQL with named parameters against the operators."""

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from merchantlens.functions.dates import Period
from merchantlens.operators import kpis
from merchantlens.operators.filters import Filters
from merchantlens.sources import sql

PERIOD = Period.of("2024-10-01", "2024-10-03")


@pytest.mark.parametrize(
    "chosen",
    [
        Filters(PERIOD),
        Filters(PERIOD, "SaaS"),
        Filters(PERIOD, None, "Merchant_2"),
        Filters(PERIOD, "SaaS", "Merchant_2"),
        Filters(Period.of("2030-01-01", "2030-01-31")),
    ],
)
def test_the_same_as_the_operators(daily, merchants, chosen):
    asked = sql.selected(sql.HEADLINE, daily, merchants, chosen)
    assert asked.columns == kpis.headline(daily, merchants, chosen).columns
    assert rows(asked) == rows(kpis.headline(daily, merchants, chosen))
    assert rows(sql.selected(sql.SERIES, daily, merchants, chosen)) == rows(kpis.revenue_series(daily, merchants, chosen))


@pytest.mark.parametrize("name", ["O'Brien", '"; DROP TABLE x; --', "{daily}", ":start", "a\\'b", "x' OR '1'='1"])
def test_any_name_is_a_name(daily, merchants, name):
    named = merchants.withColumn("merchant_name", F.when(F.col("merchant_id") == "m1", F.lit(name)).otherwise("other"))
    chosen = Filters(PERIOD, None, name)
    found = sql.selected(sql.HEADLINE, daily, named, chosen).first()
    assert found.total_txns == 4 and rows(kpis.headline(daily, named, chosen)) == [tuple(found)]


def test_bounds_reach_the_scan_and_no_view_is_left(spark, daily, merchants, tmp_path):
    daily.write.parquet(str(tmp_path / "daily"))
    stored = spark.read.parquet(str(tmp_path / "daily"))
    shown = plan(sql.selected(sql.SERIES, stored, merchants, Filters(PERIOD)))
    assert "GreaterThanOrEqual(agg_date,2024-10-01)" in shown
    assert not spark.catalog.listTables()
