"""Constant tables that come with the code."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T


def constant_table(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType) -> DataFrame:
    """A local relation: unlike one made of Python rows, its size is known to
    Catalyst, which then broadcasts it for what it is."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    table = pa.table(
        [pa.array(list(values), from_pandas=False) for values in columns], names=schema.names
    )
    return spark.createDataFrame(table, schema)
