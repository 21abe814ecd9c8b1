import pytest
from helpers import rows
from pyspark.sql import functions as F

from merchantlens import schemas
from merchantlens.functions.dates import Period
from merchantlens.operators import filters as flt, segments
from merchantlens.operators.filters import Filters

DAYS = Period.of("2024-10-01", "2024-10-03")


def test_by_category_D3(frame, merchants):
    got = [tuple(r) for r in segments.by_category(frame, merchants).collect()]
    assert got == [("SaaS", 1480.0), ("Travel", 1133.2)]


def test_top_segments_D9_S17(spark, frame, merchants):
    got = [tuple(r) for r in segments.top_segments(frame, merchants, Filters(DAYS)).collect()]
    assert got == [("SaaS", 1480.0), ("Travel", 1133.2)]
    inside = segments.top_segments(frame, merchants, Filters(DAYS, "Travel"))
    assert rows(inside) == [("Merchant_2", 1133.2)]
    namesakes = spark.createDataFrame(
        [(m, "Same", "SaaS", "SMB", None) for m in ("m1", "m2", "m3")], schemas.MERCHANTS
    )
    merged = segments.top_segments(frame, namesakes, Filters(DAYS, "SaaS"))
    assert rows(merged) == [("Same", 2623.2)]


def test_top_segments_breaks_ties_by_name_S26(frame, merchants):
    none = frame.withColumn("net_revenue", F.col("net_revenue") * 0)
    got = [r.segment for r in segments.top_segments(none, merchants, Filters(DAYS)).collect()]
    assert got == ["SaaS", "Travel"]


def test_payment_distribution_D4_S7(txns):
    got = {r.payment_method: r for r in segments.payment_distribution(txns).collect()}
    assert {k: (r.txn_count, r.total_amount) for k, r in got.items()} == {
        "UPI": (3, 560.0),
        "Credit Card": (1, 1000.0),
        "Net Banking": (1, 1000.0),
        "Debit Card": (1, 300.0),
        "Wallet": (1, 200.0),
    }
    assert got["UPI"].count_share == pytest.approx(300 / 7)
    assert got["UPI"].amount_share == pytest.approx(56000 / 3060)
    kept = segments.payment_distribution(txns, drop_null=False)
    assert kept.where("payment_method IS NULL").first().txn_count == 1


def test_payment_mix_S5(txns):
    mix = {r.payment_method: r.txn_count for r in segments.payment_mix(txns, DAYS).collect()}
    methods = ("Credit Card", "UPI", "Wallet", "Debit Card", "Net Banking", None)
    assert mix == {m: 1 for m in methods}
    whole = segments.payment_mix(txns, DAYS, include_end=True)
    got = {r.payment_method: (r.txn_count, r.total_txns) for r in whole.collect()}
    assert got["UPI"] == (3, 8) and got[None] == (1, 8)


def test_payment_mix_with_filters_S6(txns, merchants):
    mix = segments.payment_mix(
        txns, DAYS, include_end=True, merchants=merchants, chosen=Filters(DAYS, "Travel")
    )
    assert {r.payment_method: r.txn_count for r in mix.collect()} == {
        "Net Banking": 1,
        "UPI": 1,
        None: 1,
    }


def test_size_band_K6(frame):
    bands = (("Enterprise", 4.0), ("Mid-Market", 3.0))
    got = {r.merchant_id: r for r in segments.size_band(frame, bands, per_day=False).collect()}
    assert {k: r.size_band for k, r in got.items()} == {
        "m1": "Enterprise",
        "m2": "Mid-Market",
        "m3": "SMB",
    }
    assert got["m1"].mean_daily == 2.0 and got["m1"].active_days == 2
    by_day = segments.size_band(frame, (("Enterprise", 2.0), ("Mid-Market", 1.5)))
    assert {r.merchant_id: r.size_band for r in by_day.collect()} == {
        "m1": "Enterprise",
        "m2": "SMB",
        "m3": "SMB",
    }


def test_options_B5_B7(spark):
    data = [("a", "Zed", "Travel", "SMB", None), ("b", "Ann", "SaaS", "SMB", None),
            ("c", "Ann", "SaaS", "SMB", None)]
    merchants = spark.createDataFrame(data, schemas.MERCHANTS)
    assert [r[0] for r in flt.categories(merchants).collect()] == ["SaaS", "Travel"]
    assert [r[0] for r in flt.merchant_names(merchants).collect()] == ["Ann", "Ann", "Zed"]
    assert rows(flt.merchants_of(merchants, "Travel")) == [("Zed",)]
