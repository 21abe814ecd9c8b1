"""Load job: CSV files to tables and the merchant-day KPI table, all at once or by appending."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from merchantlens import schemas
from merchantlens.functions import dates
from merchantlens.operators import gate, kpis, quality
from merchantlens.operators.features import PLATFORM
from merchantlens.plans import tail
from merchantlens.session import cut_lineage
from merchantlens.sources import readers, writers
from merchantlens.sources.local import constant_table


@dataclass(frozen=True)
class Warehouse:
    """Where the tables of one warehouse folder lie."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return readers.read_table(spark, self.path(name), schemas.TABLES[name])

    def importance_path(self, level: str = PLATFORM) -> str:
        """Where the importances of the model of a level lie."""
        return self.path("feature_importance" + ("" if level == PLATFORM else f"_{level.lower()}"))


def _stored(spark: SparkSession, house: Warehouse, rows: DataFrame, name: str, key: str, parents=None) -> dict[str, int]:
    """Store what keeps the constraints and, apart, what does not; the rows of both, as written."""
    parent = None if parents is None else "merchant_id"
    accepted, rejected = gate.gate(rows, key, parent, parents)
    kept, refused = Observation(f"{name}-kept"), Observation(f"{name}-refused")
    store = writers.replace_table if parents is None else writers.store_transactions
    store(accepted, house.path(name), metrics=kept)
    writers.replace_table(rejected, house.path(f"{name}_rejected"), metrics=refused)
    return {name: kept.get["row_count"], f"{name}_rejected": refused.get["row_count"]}


def load(spark: SparkSession, merchants_csv: str, transactions_csv: str, root: str) -> DataFrame:
    """Rebuild every table from scratch; the result counts the rows written.

    Repeated keys and unknown merchants are kept out (C3, C4) and listed in the tables
    ``*_rejected``.  The CSV is parsed once; the KPI table is computed from the stored
    transactions; the counts are taken while the tables are written.
    """
    house = Warehouse(root)
    merchants = cut_lineage(readers.read_merchants(spark, merchants_csv))
    counts = _stored(spark, house, merchants, "merchants", "merchant_id")
    txns = cut_lineage(readers.read_transactions(spark, transactions_csv))
    counts |= _stored(spark, house, txns, "transactions", "transaction_id", house.table(spark, "merchants"))
    days = Observation("daily_aggregates")
    daily = kpis.daily_kpis(house.table(spark, "transactions"))
    writers.materialize_daily(daily, house.path("daily_aggregates"), metrics=days)
    stored = house.table(spark, "daily_aggregates")
    tail.rebuild(stored, house.table(spark, "merchants"), house.path("series_tail"))
    counts["daily_aggregates"] = days.get["row_count"]
    return constant_table(spark, list(counts.items()), quality.ROW_COUNTS)


def append(spark: SparkSession, transactions_csv: str, root: str) -> DataFrame:
    """Add transactions and refresh the merchant-days of their months (A3, A5).

    Rows whose id is stored already are refused, and the months of all rows of the file are
    refreshed, so a run that was lost at any point is simply run again.  Refused rows are
    added to ``transactions_rejected``.
    """
    house = Warehouse(root)
    txns = cut_lineage(readers.read_transactions(spark, transactions_csv))
    stored, merchants = house.table(spark, "transactions"), house.table(spark, "merchants")
    accepted, rejected = gate.gate(txns, "transaction_id", "merchant_id", merchants, stored)
    # Read before the table changes.
    accepted, rejected = cut_lineage(accepted), cut_lineage(rejected)
    kept = Observation("kept")
    writers.store_transactions(accepted, house.path("transactions"), "append", kept)
    refused = Observation("refused")
    writers.append_table(writers.observed(rejected, refused), house.path("transactions_rejected"))
    refresh(spark, root, months_of(txns))
    counts = {"transactions": kept.get["row_count"], "transactions_rejected": refused.get["row_count"]}
    return constant_table(spark, list(counts.items()), quality.ROW_COUNTS)


def months_of(txns: DataFrame) -> list[date | None]:
    """The months that have a transaction, None for those without a date: a row each for the driver."""
    month = dates.month_start(F.col("transaction_date")).alias("month")
    return [row.month for row in txns.select(month).distinct().collect()]


def of_months(table: DataFrame, column: str, months: list[date | None]) -> DataFrame:
    known = [month for month in months if month is not None]
    undated = F.col(column).isNull() if None in months else F.lit(False)
    return table.where(F.col(column).isin(known) | undated)


def refresh(spark: SparkSession, root: str, months: list[date | None]) -> None:
    """Compute the merchant-days of some months again from the stored transactions (A5).

    The table of last rows follows, if there is one.
    """
    house = Warehouse(root)
    touched = of_months(house.table(spark, "transactions"), "txn_month", months)
    writers.refresh_daily(kpis.daily_kpis(touched), house.path("daily_aggregates"))
    if tail.read(spark, house.path("series_tail")) is not None:
        days = of_months(house.table(spark, "daily_aggregates"), "agg_month", months)
        tail.update(days, house.table(spark, "merchants"), house.path("series_tail"))


def check(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The declared keys of the tables, checked instead of enforced."""
    house = Warehouse(root)
    merchants, txns = house.table(spark, "merchants"), house.table(spark, "transactions")
    daily = house.table(spark, "daily_aggregates")
    return {
        "duplicate_merchants": quality.duplicate_keys(merchants, "merchant_id"),
        "duplicate_transactions": quality.duplicate_keys(txns, "transaction_id"),
        "duplicate_daily": quality.duplicate_keys(daily, "agg_date", "merchant_id"),
        "orphan_merchants": quality.orphan_merchants(txns, merchants),
        "null_rates": quality.null_rates(txns),
    }


def colocate(spark: SparkSession, root: str, buckets: int, prefix: str = "colocated") -> tuple[str, str]:
    """Copies of merchants and merchant-days, bucketed alike; the names of the catalog tables.

    For many merchants, which no join broadcasts: report, comparison and selections of the
    two tables then move no row.
    """
    house = Warehouse(root)
    names = f"{prefix}_merchants", f"{prefix}_daily_aggregates"
    tables = house.table(spark, "merchants"), house.table(spark, "daily_aggregates").drop("agg_month")
    for df, name, keys in zip(tables, names, ((), ("agg_date",)), strict=True):
        writers.colocate(df, name, house.path(name), buckets, *keys)
    return names
