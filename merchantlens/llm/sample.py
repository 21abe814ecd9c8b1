"""Bounded samples by hash, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

_PARTS = 1_000_000


def by_hash(key: Column, share: float, salt: int) -> Column:
    """True for about ``share`` of the keys, the same ones each time."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(_PARTS)) < int(_PARTS * min(1.0, share))


def share_of(wanted: int, rows: int) -> float:
    """A share that seldom gives more than ``wanted`` of ``rows``; all if they are few."""
    return 1.0 if rows <= wanted else 0.95 * wanted / rows


def bounded(df: DataFrame, key: str, wanted: int, salt: int, rows: int | None = None) -> DataFrame:
    """At most ``wanted`` rows of ``df``, chosen by the hash of a key."""
    share = share_of(wanted, df.count() if rows is None else rows)
    return df.where(by_hash(F.col(key), share, salt)).limit(wanted)
