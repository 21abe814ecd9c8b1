"""Calendar expressions and analysis periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Period:
    """A closed range of days."""

    start: date
    end: date

    @classmethod
    def of(cls, start: str, end: str) -> "Period":
        return cls(date.fromisoformat(start), date.fromisoformat(end))

    def previous(self, overlap: bool = True) -> "Period":
        """The range compared against (S3).

        By default it ends on this period's first day, so that one day counts on
        both sides; ``overlap=False`` shifts it back by a day.
        """
        span = self.end - self.start
        last = self.start if overlap else self.start - timedelta(days=1)
        return Period(last - span, last)


def day_literal(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def timestamp_literal(day: date) -> Column:
    """Midnight as TIMESTAMP_NTZ, the stored type, so the bound reaches the scan."""
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def day_of_week(day: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day)


def is_weekend(day: Column) -> Column:
    return F.weekday(day).isin(5, 6).cast("int")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")
