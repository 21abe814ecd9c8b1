"""The star-schema tables seen as merchants, transactions and questions.

``customer`` plays the merchants and ``orders`` the transactions; both mappings
are plain projections, so filters and column choices still reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from merchantlens.operators import enrich

# The columns in use, declared: no file is opened to find out a schema.
CUSTOMER = "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING"
ORDERS = (
    "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, "
    "o_orderpriority STRING"
)
CONVERSATIONS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"

# Payment method by order priority, size by account balance,
# status by the last two digits of the order key.
PAYMENT_METHOD = """
    CASE WHEN o_orderkey % 97 = 0 THEN NULL
         WHEN o_orderpriority = '1-URGENT' THEN 'Credit Card'
         WHEN o_orderpriority = '2-HIGH' THEN 'Debit Card'
         WHEN o_orderpriority = '3-MEDIUM' THEN 'UPI'
         WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Net Banking'
         WHEN o_orderpriority = '5-LOW' THEN 'Wallet' END AS payment_method"""
BUSINESS_SIZE = """
    CASE WHEN c_acctbal >= 9000 THEN 'Enterprise'
         WHEN c_acctbal >= 6000 THEN 'Mid-Market'
         ELSE 'SMB' END AS business_size"""
PAYMENT_STATUS = """
    CASE WHEN o_orderkey % 100 < 7 THEN 'Failed'
         WHEN o_orderkey % 100 < 10 THEN 'Refunded'
         ELSE 'Successful' END AS payment_status"""


def _table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer", CUSTOMER)


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customers(spark, sf_dir).selectExpr(
        "c_custkey AS merchant_id",
        "c_name AS merchant_name",
        "c_mktsegment AS business_category",
        BUSINESS_SIZE,
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders", ORDERS).selectExpr(
        "o_orderkey AS transaction_id",
        "o_custkey AS merchant_id",
        "o_orderdate AS transaction_date",
        "CAST(o_totalprice AS DECIMAL(18,2)) AS transaction_amount",
        PAYMENT_METHOD,
        PAYMENT_STATUS,
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich.settle(raw_transactions(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "conversations", CONVERSATIONS)
        .where(F.col("role") == "user")
        .select("conv_id", "turn", "text")
    )
