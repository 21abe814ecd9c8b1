import pytest
from helpers import day, plan, rows
from pyspark.sql import functions as F

from merchantlens import schemas, session
from merchantlens.functions.dates import Period
from merchantlens.operators import filters as flt, kpis, segments
from merchantlens.sources import readers, writers

MERCHANTS_CSV = """merchant_id,merchant_name,business_category,business_size,onboarding_date
m1,Merchant_1,SaaS,SMB,2022-10-30
m2,Merchant_2,Travel,Enterprise,2022-08-10
"""

TRANSACTIONS_CSV = """transaction_id,merchant_id,transaction_date,transaction_amount,payment_method,payment_status,processing_fee,refund_amount,settlement_amount
t1,m1,2024-10-01 10:05:00,1000.0,Credit Card,Successful,20.0,0.0,980.0
t2,m1,2024-10-02 11:00:00,200.5,,Refunded,0.0,200.5,0.0
"""


@pytest.fixture()
def csvs(tmp_path):
    (tmp_path / "m.csv").write_text(MERCHANTS_CSV)
    (tmp_path / "t.csv").write_text(TRANSACTIONS_CSV)
    return str(tmp_path / "m.csv"), str(tmp_path / "t.csv")


def test_read_merchants_A1(spark, csvs):
    df = readers.read_merchants(spark, csvs[0])
    assert df.schema == schemas.MERCHANTS
    assert rows(df)[0] == ("m1", "Merchant_1", "SaaS", "SMB", day("2022-10-30"))


def test_read_transactions_A2(spark, csvs):
    df = readers.read_transactions(spark, csvs[1])
    assert df.schema == schemas.TRANSACTIONS
    first, second = df.orderBy("transaction_id").collect()
    assert str(first.transaction_date) == "2024-10-01 10:05:00"
    assert str(second.transaction_amount) == "200.50" and second.payment_method is None


def test_malformed_and_misnamed_files_stop_the_job(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(TRANSACTIONS_CSV.replace("1000.0", "lots"))
    (tmp_path / "names.csv").write_text(MERCHANTS_CSV.replace("merchant_name", "label"))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ"):
        readers.read_transactions(spark, str(tmp_path / "bad.csv")).collect()
    with pytest.raises(Exception):
        readers.read_merchants(spark, str(tmp_path / "names.csv")).collect()


def test_append_and_replace_A3_A4(spark, merchants, tmp_path):
    path = str(tmp_path / "merchants")
    writers.replace_table(merchants, path)
    writers.append_table(merchants, path)
    assert readers.read_table(spark, path).count() == 4
    writers.replace_table(merchants, path)
    assert readers.read_table(spark, path).count() == 2


def test_stored_daily_prunes_months_A5_A14(spark, txns, tmp_path):
    path = str(tmp_path / "daily")
    later = txns.withColumn("transaction_date", F.expr("transaction_date + INTERVAL 60 DAYS"))
    writers.materialize_daily(kpis.daily_kpis(txns.unionByName(later)), path)
    stored = readers.read_table(spark, path)
    assert dict(stored.dtypes)["agg_month"] == "date"
    october = flt.date_range(stored, Period.of("2024-10-01", "2024-10-31"))
    assert "PartitionFilters: [isnotnull(agg_month" in plan(october)
    got = kpis.platform_trend(october)
    assert rows(got) == rows(kpis.platform_trend(kpis.measures(txns)))


def test_stored_transactions_A14(spark, txns, tmp_path):
    path = str(tmp_path / "txns")
    writers.store_transactions(txns, path)
    stored = readers.read_table(spark, path)
    assert rows(stored.select(txns.columns)) == rows(txns)
    days = Period.of("2024-10-01", "2024-10-03")
    assert rows(segments.payment_mix(stored, days)) == rows(segments.payment_mix(txns, days))
    assert rows(kpis.platform_trend(flt.date_range(kpis.measures(stored), days))) == rows(
        kpis.platform_trend(kpis.measures(txns))
    )


def test_write_csv_without_internal_columns_A12(spark, merchants, tmp_path):
    path = str(tmp_path / "csv")
    writers.write_csv(merchants.withColumn("growth_rate", F.lit(1.1)), path, drop=("growth_rate",))
    assert rows(readers.read_merchants(spark, path)) == rows(merchants)


def test_importance_csv_A10(spark, tmp_path):
    path = str(tmp_path / "importance")
    data = [("month", 0.25), ("revenue_lag_1", 0.75)]
    writers.write_importance(spark.createDataFrame(data, schemas.FEATURE_IMPORTANCE), path)
    assert [tuple(r) for r in readers.read_importance(spark, path).collect()] == data[::-1]


def test_cut_lineage_keeps_rows_and_schema(spark, daily):
    cut = session.cut_lineage(daily)
    assert rows(cut) == rows(daily) and cut.dtypes == daily.dtypes
    assert "FileScan parquet" in plan(cut) and "Aggregate" not in plan(cut)


def test_shared_dir_is_the_one_the_session_names(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    first, second = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert first.startswith(f"{named}/x-") and first != second
