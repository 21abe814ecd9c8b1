"""What answers quote about a selection, kept between calls.

The headline figures and the most used payment method of a selection are written below
the warehouse under a name made of the selection and of the state of the tables, so they
are read again until a load, an append or a refresh changes a table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from merchantlens.functions import rules
from merchantlens.operators import insights, kpis, segments
from merchantlens.operators.filters import Filters
from merchantlens.plans.load import Warehouse

TABLES = ("merchants", "transactions", "daily_aggregates")


def _folder(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def state(spark: SparkSession, house: Warehouse) -> str | None:
    """When each table was written last; None where a table does not say."""
    times = []
    for table in TABLES:
        path, store = _folder(spark, f"{house.path(table)}/_SUCCESS")
        if not store.exists(path):
            return None
        times.append(str(store.getFileStatus(path).getModificationTime()))
    return ",".join(times)


def _stored(spark: SparkSession, path: str, compute) -> DataFrame:
    """A small table read from ``path``, computed and written first if it is not complete there."""
    done, store = _folder(spark, f"{path}/_SUCCESS")
    if not store.exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def facts(spark: SparkSession, root: str, chosen: Filters) -> tuple[DataFrame, DataFrame]:
    """(headline, top method) of a selection, from the kept tables where they are current."""
    house = Warehouse(root)
    merchants, txns, daily = (house.table(spark, name) for name in TABLES)

    def headline() -> DataFrame:
        return kpis.headline(daily, merchants, chosen)

    def top() -> DataFrame:
        return insights.top_method(segments.payment_mix(txns, chosen.period))

    current = state(spark, house)
    if current is None:
        return headline(), top()
    named = repr((chosen.period.start.isoformat(), chosen.period.end.isoformat(), chosen.category, chosen.merchant, current))
    folder = house.path(f"selections/{hashlib.sha256(named.encode()).hexdigest()[:32]}")
    return _stored(spark, f"{folder}/headline", headline), _stored(spark, f"{folder}/top", top)


def ask(
    spark: SparkSession, root: str, questions: DataFrame, chosen: Filters, horizon: int = rules.HORIZON
) -> DataFrame:
    """Answers to a table of questions (``text``) about a selection of the stored tables."""
    headline, top = facts(spark, root, chosen)
    return insights.answers(insights.route(questions), headline, top, horizon)
