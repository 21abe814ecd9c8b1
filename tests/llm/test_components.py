"""Rounds, parts of long lists and scratch tables of the n-gram Jaccard join."""

import random
import time
from pathlib import Path

from helpers import plan
from pyspark.sql import functions as F
from test_documents import plain_components

from merchantlens.llm import jaccard
from merchantlens.session import DROP_SHUFFLES, cut_lineage, discard, shared_dir


def cuts(spark):
    return {p.name for p in Path(shared_dir(spark)).iterdir() if p.name.startswith("cut-")}


def found(spark, links):
    df = spark.createDataFrame(links, "a long, b long")
    return {r.cid: r.root for r in jaccard.components(df).collect()}


def test_rounds_on_chains_are_few(spark, monkeypatch):
    written = []
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    rising = [(n, n + 1) for n in range(200)]
    assert set(found(spark, rising).values()) == {0}
    # One round: links, roots, first neighbours, doublings (log2 of 200 and one that moves nothing), both tables.
    assert len(written) <= 5 + 9
    written.clear()
    ids = list(range(200))
    random.Random(3).shuffle(ids)
    got = found(spark, list(zip(ids[:120], ids[1:121], strict=True)) + list(zip(ids[130:], ids[131:], strict=False)))
    assert {got[i] for i in ids[:121]} == {min(ids[:121])} and {got[i] for i in ids[130:]} == {min(ids[130:])}
    assert len(written) <= 2 + 8 * 11


def test_scratch_tables_are_removed(spark, documents):
    text = " ".join(f"w{n}" for n in range(60))
    docs = documents([(n, f"{text} x{n % 7}") for n in range(30)] + [(n, f"other {n} " * 4) for n in range(30, 60)])
    before = cuts(spark)
    assert jaccard.join(docs).where("component_id = 0").count() == 30
    left = cuts(spark) - before
    assert len(left) <= 3  # what the result itself reads
    table = cut_lineage(spark.range(5))
    assert cuts(spark) - before - left
    discard(table)
    assert cuts(spark) - before == left
    discard(spark.range(3))


def test_lists_in_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_ROWS", 5)
    rng = random.Random(6)
    shared = [f"page{n}" for n in range(60)]
    texts = []
    for n in range(60):
        own = [f"own{rng.randrange(10**6)}" for _ in range(rng.choice([1, 3, 8, 14]))]
        texts.append(" ".join([*own, *shared[rng.randrange(3) :]]))
    texts += [" ".join(f"o{n % 9}x{m}" for m in range(30)) + f" e{n}" for n in range(30)]
    for rule in (jaccard.Rule(), jaccard.Rule(5, 80, 100), jaccard.Rule(2, 60, 100)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(list(enumerate(texts))), rule=rule).collect()}
        assert got == dict(enumerate(plain_components(texts, rule)))


def shuffles(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {str(p) for folder in manager.localDirsString() for p in Path(folder).rglob("shuffle_*")}


def test_shuffle_files_go_with_the_table(spark):
    before, setting = shuffles(spark), spark.conf.get(DROP_SHUFFLES, None)
    counts = spark.range(10_000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    table = cut_lineage(counts)
    until = time.time() + 20
    while shuffles(spark) - before and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not shuffles(spark) - before
    assert table.count() == counts.count() == 7
    assert shuffles(spark) - before and spark.conf.get(DROP_SHUFFLES, None) == setting


def test_entries_and_rows_are_moved_once(spark, documents, monkeypatch):
    rows = [(n, " ".join(f"w{n // 3}x{m}" for m in range(40)) + f" e{n}") for n in range(30)]
    plans = []
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: plans.append(plan(df)) or cut_lineage(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.first_of_each(documents(rows))
        shown = plan(kept)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 30, 3))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    entries = [p for p in plans if "classes" in p and "pos" in p and "MapInArrow" in p]
    assert len(entries) == 1 and entries[0].count("hashpartitioning(token") == 1
    assert shown.count("Exchange hashpartitioning(id#") == 1 and "cast(id#" not in shown


def test_pairs_meet_once_not_in_each_shared_list(documents, monkeypatch):
    rng, texts, owned, counted = random.Random(9), [], [], []
    for group in range(3):  # pages of a template, too different to link
        page = " ".join(f"g{group}w{n}" for n in range(200))
        owned += (own := [" ".join(f"own{rng.randrange(10**9)}" for _ in range(60)) for _ in range(12)])
        texts += [f"{page} {words}" for words in own]
    texts += [f"{texts[3]} end", f"{texts[20]} end of it"]
    # What a page has alone is frequent elsewhere, so the template comes first in the order.
    texts += [" ".join([*owned, *(f"z{n}" for n in range(m))]) for m in range(20)]
    real = jaccard._across

    def across(lists, roots, classes, rule, boundary):
        met = jaccard._met(lists, roots, rule, boundary)
        counted.append((met.count(), met.distinct().count()))
        return real(lists, roots, classes, rule, boundary)

    monkeypatch.setattr(jaccard, "_across", across)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(plain_components(texts, jaccard.Rule())))
    [(rows, pairs)] = counted; print(rows, pairs)
    assert 3 * 12 * 11 // 2 <= pairs <= rows <= 2 * pairs
