import random
from decimal import Decimal

import pytest
from helpers import rows
from pyspark.sql import functions as F

from merchantlens.functions import numbers


def test_cents_of_both_types_agree(spark):
    rng = random.Random(7)
    whole = [rng.randint(-(10**14), 10**14) for _ in range(2000)] + [0, 1, -1, 115, 2675]
    data = [(Decimal(c).scaleb(-2), float(Decimal(c).scaleb(-2)), c) for c in whole]
    df = spark.createDataFrame(data, "exact decimal(18,2), stored double, cents bigint")
    got = df.select(numbers.cents(df, "exact"), numbers.cents(df, "stored"), "cents").collect()
    assert all(a == b == c for a, b, c in got)


def test_sum_does_not_depend_on_order(spark):
    data = [(0.1,), (0.2,), (1e11,), (0.3,), (-1e11,)]
    df = spark.createDataFrame(data, "v double")
    for order in (F.col("v"), F.col("v").desc()):
        assert df.orderBy(order).agg(numbers.exact_sum(df, "v")).first()[0] == Decimal("0.60")


def test_sum_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v decimal(18,2)")
    assert rows(df.agg(numbers.exact_sum(df, "v"))) == [(None,)]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("sign", [1, -1])
def test_sums_beyond_64_bits_are_exact(spark, ansi, sign):
    most = sign * Decimal("9999999999999999.99")
    df = spark.createDataFrame([(most,)] * 20, "v decimal(18,2)")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        summed = df.agg(numbers.exact_sum(df, "v").alias("v"))
        assert summed.first()[0] == 20 * most
        again = summed.unionAll(summed)
        assert again.agg(numbers.exact_sum(again, "v")).first()[0] == 40 * most
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_formats_of_nothing_are_null(spark):
    df = spark.createDataFrame([(None,)], "v double")
    v = F.col("v")
    assert rows(df.select(numbers.thousands(v), numbers.crores(v), numbers.one_decimal(v))) == [(None,) * 3]


def test_percent_of_nothing_is_null_S23(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 4), (None, 4)], "a int, b int")
    got = [r[0] for r in df.select(numbers.percent(F.col("a"), F.col("b"))).collect()]
    assert got == [None, None, 25.0, None]


def test_formats_H14(spark):
    df = spark.createDataFrame([(1234567.6, 123456789.0, 4.25)], "a double, b double, c double")
    got = df.select(
        numbers.thousands(F.col("a")), numbers.crores(F.col("b")), numbers.one_decimal(F.col("c"))
    )
    assert rows(got) == [("1,234,568", "12.35", "4.3")]
