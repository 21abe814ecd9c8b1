"""Ratios, exact sums and number formatting."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` as DOUBLE; NULL when ``whole`` is 0 or NULL."""
    return F.try_divide(F.lit(100.0) * part.cast("double"), whole.cast("double"))


def cents(df: DataFrame, name: str) -> Column:
    """A money column in whole cents, as BIGINT.

    Integer sums do not depend on row order and cost a fraction of DECIMAL ones.
    Transactions carry DECIMAL with two places; stored daily rows carry DOUBLE,
    whose cents are recovered by rounding.
    """
    value = F.col(name)
    if isinstance(df.schema[name].dataType, T.DecimalType):
        return (value * F.lit(100)).cast("bigint")
    return F.rint(value * F.lit(100.0)).cast("bigint")


def exact_sum(df: DataFrame, name: str) -> Column:
    """Sum of a money column as DECIMAL(30, 2).

    Cents are added up in three BIGINT sums of six digits each (the first holds
    the rest), so none overflows below nine trillion rows, ANSI mode or not.
    DECIMALs that do not fit a BIGINT, sums themselves, are added as they are.
    """
    kind = df.schema[name].dataType
    if isinstance(kind, T.DecimalType) and kind.precision > 18:
        return F.sum(name).cast("decimal(30,2)")
    value, million = cents(df, name), F.lit(1_000_000)
    high = F.call_function("div", value, F.lit(1_000_000_000_000))
    middle = F.call_function("div", value, million) % million
    parts = [F.sum(part).cast("decimal(20,0)") for part in (high, middle, value % million)]
    scales = (Decimal("10000000000.00"), Decimal("10000.00"), Decimal("0.01"))
    return sum(
        ((part * F.lit(scale)).cast("decimal(36,2)") for part, scale in zip(parts[1:], scales[1:])),
        (parts[0] * F.lit(scales[0])).cast("decimal(36,2)"),
    ).cast("decimal(30,2)")


def thousands(value: Column) -> Column:
    """``1234567.8`` as ``1,234,568``."""
    return F.format_number(value.cast("double"), 0)


def one_decimal(value: Column) -> Column:
    """``4.25`` as ``4.3``; NULL stays NULL, as in every format here."""
    return F.when(value.isNotNull(), F.format_string("%.1f", F.round(value, 1)))


def crores(value: Column) -> Column:
    """Amount in units of ten million, two decimals."""
    return F.when(value.isNotNull(), F.format_string("%.2f", F.round(value / F.lit(10000000.0), 2)))
