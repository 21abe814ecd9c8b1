"""Every registered query against its DuckDB text on the test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from merchantlens import oracle, registry

SF = "/root/testdata/sf0.01"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()
LEARNED = {"gbt_forecast": 150, "gbt_importance": 6, "gbt_backtest": 5}

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def ordered(found):
    return sorted(found, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_only_learned_queries_lack_a_text():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set(LEARNED)


def test_entry(spark):
    assert entry.entry(spark).columns == ["agg_date", "total_revenue", "total_txns"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = ordered(tuple(r) for r in df.select(*columns).collect())
    quoted = ", ".join(f'"{c}"' for c in columns)
    relation = duck.sql(ORACLE[name])
    assert sorted(relation.columns) == columns
    assert mine == ordered(duck.sql(f"SELECT {quoted} FROM ({ORACLE[name]})").fetchall())


@pytest.mark.parametrize("name, count", LEARNED.items())
def test_learned_query(spark, name, count):
    assert QUERIES[name](spark, SF).count() == count
