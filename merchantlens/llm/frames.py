"""Schemas of the frames that Python code in tasks returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def carried(rows: DataFrame, *names: str, new: str) -> T.StructType:
    """The columns ``names`` of ``rows`` as they are, followed by ``new`` (DDL)."""
    return T.StructType([*[rows.schema[name] for name in names], *T.StructType.fromDDL(new).fields])
