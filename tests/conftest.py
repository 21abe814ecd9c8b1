import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from helpers import day, series_of
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from merchantlens import schemas  # noqa: E402
from merchantlens.operators import enrich, kpis  # noqa: E402
from merchantlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(cores=8, partitions=4, spark__checkpoint__dir=shared)
    yield session
    session.stop()


RAW = T.StructType(schemas.TRANSACTIONS.fields[:6])

# The micro table M1: id, merchant, time, amount, method, status.
M1 = [
    ("t1", "m1", "2024-10-01 10:05", "1000.00", "Credit Card", "Successful"),
    ("t2", "m1", "2024-10-01 11:00", "500.00", "UPI", "Successful"),
    ("t3", "m1", "2024-10-01 12:00", "200.00", "Wallet", "Refunded"),
    ("t4", "m1", "2024-10-02 09:00", "300.00", "Debit Card", "Failed"),
    ("t5", "m2", "2024-10-01 00:00", "1000.00", "Net Banking", "Successful"),
    ("t6", "m2", "2024-10-02 23:59", "100.00", None, "Successful"),
    ("t7", "m2", "2024-10-03 00:00", "50.00", "UPI", "Successful"),
    ("t8", "m3", "2024-10-03 08:00", "10.00", "UPI", "Successful"),
]


@pytest.fixture(scope="session")
def raw(spark):
    data = [
        (i, m, dt.datetime.fromisoformat(at), Decimal(amount), method, status)
        for i, m, at, amount, method, status in M1
    ]
    return spark.createDataFrame(data, RAW)


@pytest.fixture(scope="session")
def txns(raw):
    return enrich.settle(raw)


@pytest.fixture(scope="session")
def merchants(spark):
    data = [
        ("m1", "Merchant_1", "SaaS", "SMB", day("2022-01-01")),
        ("m2", "Merchant_2", "Travel", "SMB", day("2022-02-01")),
    ]
    return spark.createDataFrame(data, schemas.MERCHANTS)


@pytest.fixture(scope="session")
def daily(txns):
    return kpis.daily_kpis(txns)


@pytest.fixture(scope="session", params=["transactions", "merchant_days"])
def frame(request, txns, daily):
    """Both grains of a measure frame; every KPI must come out the same."""
    return kpis.measures(txns) if request.param == "transactions" else daily


@pytest.fixture(scope="session")
def ramp(spark):
    """The micro series M2: 1..40 from Monday 2024-01-01."""
    return series_of(spark, range(1, 41))

