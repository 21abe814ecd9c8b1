"""Access paths of stored transactions."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from merchantlens.operators import enrich
from merchantlens.sources import readers, writers


def store(spark, path):
    """One month of 40 merchants; merchant 7 holds a third of all rows."""
    raw = spark.range(6000, numPartitions=4).select(
        F.col("id").cast("string").alias("transaction_id"),
        F.expr("format_string('m%02d', IF(id % 3 = 0, 7, id % 40))").alias("merchant_id"),
        F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(CAST(id % 30 AS INT), 0, 0, id)").alias("transaction_date"),
        F.lit(10).cast("decimal(18,2)").alias("transaction_amount"),
        F.lit("UPI").alias("payment_method"),
        F.lit("Successful").alias("payment_status"),
    )
    writers.store_transactions(enrich.settle(raw), path)


def test_stored_transactions_are_pruned_by_merchant(spark, tmp_path):
    path = tmp_path / "txns"
    conf = {
        "spark.sql.shuffle.partitions": "12",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        store(spark, str(path))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    ranges = []
    for file in path.rglob("*.parquet"):
        meta = pq.read_metadata(file)
        column = next(c for c in range(meta.num_columns) if meta.schema.column(c).name == "merchant_id")
        for group in range(meta.num_row_groups):
            stats = meta.row_group(group).column(column).statistics
            ranges.append((stats.min, stats.max, meta.row_group(group).num_rows))
    assert len(ranges) >= 10 and sum(n for _, _, n in ranges) == 6000
    rare = [r for r in ranges if r[0] <= "m20" <= r[1]]
    assert len(rare) <= 2  # the others are skipped by their min and max
    hot = [r for r in ranges if r[0] <= "m07" <= r[1]]
    assert len(hot) >= 3 and max(n for _, _, n in ranges) < 1500  # a hot merchant is split by date
    stored = readers.read_table(spark, str(path)).where("merchant_id = 'm20'")
    assert stored.count() == 100
