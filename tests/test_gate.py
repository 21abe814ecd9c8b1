"""Constraints at load, appends and the refresh of their months."""

import datetime as dt
from collections import Counter
from decimal import Decimal
from pathlib import Path

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from merchantlens import __main__ as command
from merchantlens.operators import enrich, gate, skew
from merchantlens.plans import load
from merchantlens.sources import writers

SCHEMA = "id string, parent string, x int"


def plain(found, parents, stored=()):
    """The accepted rows and the rejected ones with reason and copies."""
    accepted, rejected, fine = [], Counter(), {}
    for row in found:
        if row[0] is None:
            rejected[*row, "missing_key"] += 1
        elif row[1] is None:
            rejected[*row, "missing_parent"] += 1
        elif row[1] not in parents:
            rejected[*row, "unknown_parent"] += 1
        else:
            fine.setdefault(row[0], []).append(row)
    for key, same in fine.items():
        same.sort(key=lambda r: tuple((v is not None, v) for v in r))
        if key in stored:
            rejected.update((*row, "stored_key") for row in same)
            continue
        accepted.append(same[0])
        rejected.update((*row, "repeated_key") for row in same[1:])
    return sorted(accepted, key=str), sorted(((*row, n) for row, n in rejected.items()), key=str)


@pytest.mark.parametrize("heavy", [1, 3, 10_000])
def test_gate_against_plain_version(spark, monkeypatch, heavy):
    monkeypatch.setattr(skew.lookup, "__defaults__", ("n", None, heavy))
    found = [(f"k{n % 40}", f"p{n % 5}", n % 3 or None) for n in range(60)]
    found += [("hot", "p1", n) for n in range(50)] + [("hot", "p1", 0)] * 20 + [(f"own{n}", "p2", n) for n in range(30)]
    found += [(None, "p1", 1)] * 25 + [("a", None, n % 2) for n in range(25)] + [(None, None, None), ("b", "lost", 1)]
    found += [(f"c{n}", "lost", n) for n in range(40)] + [("k1", "lost", 9), ("", "p1", 1)]
    parents = spark.createDataFrame([("p1",), ("p1",), ("p2",), ("p3",), (None,)], "parent string")
    stored = spark.createDataFrame([("own3",), ("own4",), ("hot2",), (None,)], "id string")
    table = spark.createDataFrame(found, SCHEMA).repartition(7)
    accepted, rejected = gate.gate(table, "id", "parent", parents, stored)
    expected = plain(found, {"p1", "p2", "p3"}, {"own3", "own4", "hot2"})
    assert (rows(accepted), rows(rejected)) == expected
    again, refused = gate.gate(table.select("id", "x"), "id")
    assert again.count() == len({row[0] for row in found} - {None})
    assert refused.agg(F.sum("copies")).first()[0] + again.count() == len(found)


def test_gate_of_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    accepted, rejected = gate.gate(empty, "id", "parent", spark.createDataFrame([], "parent string"))
    assert accepted.columns == empty.columns and accepted.count() == rejected.count() == 0


@pytest.mark.parametrize("heavy", [2, 10_000])
def test_lookup_finds_every_key(spark, heavy):
    table = spark.createDataFrame([("a", 50, 1), ("b", 3, 2), ("c", 1, 3)], "k string, n int, v int")
    found = spark.createDataFrame([(k,) for k in ["a"] * 50 + ["b"] * 3 + ["c", "d", None, None]], "k string")
    got = skew.lookup(found, table, "k", heavy=heavy).select("k", "found.v")
    assert Counter(rows(got)) == {("a", 1): 50, ("b", 2): 3, ("c", 3): 1, ("d", None): 1, (None, None): 2}
    only = skew.lookup(found, table, "k", light=F.col("v") == 3, heavy=heavy)
    assert only.where("found.v = 3").count() == 1


# --- Jobs --------------------------------------------------------------------


def transactions(spark, numbers, merchants="m{}"):
    data = [
        (
            f"t{n}", merchants.format(n % 3), dt.datetime(2024, 1, 5) + dt.timedelta(days=n % 150),
            Decimal(100 + n % 17), "UPI" if n % 2 else "Wallet", "Failed" if n % 20 == 0 else "Successful",
        )
        for n in numbers
    ]
    names = "transaction_id string, merchant_id string, transaction_date timestamp_ntz, "
    return enrich.settle(
        spark.createDataFrame(data, names + "transaction_amount decimal(18,2), payment_method string, payment_status string")
    )


@pytest.fixture
def files(spark, tmp_path):
    merchants = spark.createDataFrame(
        [(f"m{i}", f"Merchant_{i}", "SaaS", "SMB", dt.date(2022, 1, 1)) for i in (0, 1, 2, 2)],
        "merchant_id string, merchant_name string, business_category string, business_size string, onboarding_date date",
    )
    writers.write_csv(merchants, str(tmp_path / "m.csv"))
    first = transactions(spark, range(600))
    writers.write_csv(first.unionAll(first.where("transaction_id = 't7'")), str(tmp_path / "t.csv"))
    # Rows of two months, two of which are stored already and one of which has no merchant.
    late = [n for n in range(600, 1200) if n % 150 > 120]
    more = transactions(spark, [*late, 5, 125]).unionAll(transactions(spark, [10_000], "gone"))
    writers.write_csv(more, str(tmp_path / "more.csv"))
    writers.write_csv(first.unionAll(transactions(spark, late)), str(tmp_path / "all.csv"))
    return tmp_path


def job(spark, *argv):
    return command.run(spark, command.arguments([str(a) for a in argv]))


def table(spark, root, name):
    return rows(load.Warehouse(str(root)).table(spark, name).drop("txn_month", "agg_month"))


def written(root, month):
    return {p.name: p.stat().st_mtime_ns for p in Path(root, "daily_aggregates", f"agg_month={month}").iterdir()}


def test_load_keeps_the_constraints_and_counts_as_it_writes(spark, files):
    counts = load.load(spark, str(files / "m.csv"), str(files / "t.csv"), str(files / "house"))
    assert rows(counts) == [
        ("daily_aggregates", 150), ("merchants", 3), ("merchants_rejected", 1), ("transactions", 600),
        ("transactions_rejected", 1),
    ]
    assert "FileScan" not in plan(counts)
    refused = spark.read.parquet(str(files / "house" / "transactions_rejected")).collect()
    assert [(r.transaction_id, r.reason, r.copies) for r in refused] == [("t7", "repeated_key", 1)]
    checked = load.check(spark, str(files / "house"))
    assert all(checked[name].count() == 0 for name in checked if name != "null_rates")


def test_append_and_refresh_equal_a_rebuild(spark, files, capsys):
    house, whole = files / "house", files / "whole"
    load.load(spark, str(files / "m.csv"), str(files / "t.csv"), str(house))
    before = {month: written(house, month) for month in ("2024-01-01", "2024-02-01", "2024-05-01")}
    job(spark, "append", files / "more.csv", house)
    assert "transactions_rejected|3" in capsys.readouterr().out.replace(" ", "")
    load.load(spark, str(files / "m.csv"), str(files / "all.csv"), str(whole))
    for name in ("transactions", "daily_aggregates"):
        assert table(spark, house, name) == table(spark, whole, name)
    # t5 was refused, but its month is refreshed; the month that no row of the file has is left.
    after = {month: written(house, month) for month in before}
    assert after["2024-02-01"] == before["2024-02-01"] and after["2024-05-01"] != before["2024-05-01"]
    stored = table(spark, house, "daily_aggregates")
    job(spark, "append", files / "more.csv", house)  # as after a lost run
    assert table(spark, house, "daily_aggregates") == stored
    assert table(spark, house, "transactions") == table(spark, whole, "transactions")


def test_a_run_lost_between_append_and_refresh(spark, files):
    house, whole = files / "house", files / "whole"
    load.load(spark, str(files / "m.csv"), str(files / "t.csv"), str(house))
    late = transactions(spark, [n for n in range(600, 1200) if n % 150 > 120])
    writers.store_transactions(late, str(house / "transactions"), "append")
    load.append(spark, str(files / "more.csv"), str(house))
    load.load(spark, str(files / "m.csv"), str(files / "all.csv"), str(whole))
    for name in ("transactions", "daily_aggregates"):
        assert table(spark, house, name) == table(spark, whole, name)


def test_undated_rows_are_refreshed(spark, tmp_path):
    house = load.Warehouse(str(tmp_path))
    txns = transactions(spark, range(30)).withColumn("transaction_date", F.expr("if(transaction_id = 't3', null, transaction_date)"))
    writers.store_transactions(txns, house.path("transactions"))
    load.refresh(spark, house.root, load.months_of(txns))
    assert house.table(spark, "daily_aggregates").where("agg_date IS NULL").count() == 1
