from helpers import rows

from merchantlens.operators import quality


def test_row_counts_A6(txns, merchants, daily):
    got = quality.row_counts({"merchants": merchants, "transactions": txns, "daily": daily})
    assert rows(got) == [("daily", 6), ("merchants", 2), ("transactions", 8)]


def test_orphans_C3(txns, merchants):
    assert [r.transaction_id for r in quality.orphans(txns, merchants).collect()] == ["t8"]
    assert rows(quality.orphan_merchants(txns, merchants)) == [("m3", 1)]


def test_a_transaction_without_merchant_is_an_orphan(spark, txns, merchants):
    from pyspark.sql import functions as F

    nameless = txns.withColumn("merchant_id", F.lit(None).cast("string"))
    assert quality.orphans(nameless, merchants).count() == 8


def test_duplicate_keys_C4(raw):
    assert rows(quality.duplicate_keys(raw, "transaction_id")) == []
    assert rows(quality.duplicate_keys(raw.union(raw.limit(1)), "transaction_id")) == [("t1", 2)]
    assert rows(quality.duplicate_keys(raw, "merchant_id", "payment_status")) == [
        ("m1", "Successful", 2),
        ("m2", "Successful", 3),
    ]


def test_null_rates_K7(raw):
    got = {r.column_name: r for r in quality.null_rates(raw).collect()}
    assert got["payment_method"].null_rate == 1 / 8
    assert {r.null_count for k, r in got.items() if k != "payment_method"} == {0}


def test_null_rates_of_nothing(raw):
    assert {r.null_rate for r in quality.null_rates(raw.limit(0)).collect()} == {None}
