"""Scans (A1, A2, A8, A10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T

from merchantlens import schemas


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST"
) -> DataFrame:
    """CSV with a header row; the header must agree with the declared schema.

    A malformed record stops the job unless ``mode`` says otherwise.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", mode)
        .csv(path)
    )


def read_merchants(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.MERCHANTS)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """File splits bound the memory of a task, however large the file is."""
    return read_csv(spark, path, schemas.TRANSACTIONS)


def read_importance(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.FEATURE_IMPORTANCE)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; its month folders come back as a DATE column.

    With a declared schema nothing is inferred, neither from files nor from folder names.
    """
    if schema is None:
        return spark.read.parquet(path)
    return spark.read.schema(schema).parquet(path).select(schema.names)


def if_present(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` returns, or ``None`` where its path does not exist (A10)."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
