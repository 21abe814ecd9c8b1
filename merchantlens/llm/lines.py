"""Operator 7, line dedup: levelled sorted runs of line hashes.

Documents come in batches.  A batch's line keys are counted by document,
merge-anti-joined with the runs' settled keys (those already found in enough
documents, which need no more counting), and the rest is added as a sorted run
of level 0.  ``fanout`` runs of a level are compacted into one of the next, so
few runs are open at any time.  Runs are bucketed tables sorted by hash: merging
them and joining them shuffles no run again.  A key is identified by 128 bits.

The lines of frequent keys are then dropped.  The join of the postings with the
frequent keys is split: keys that hold over 1/``HEAVY`` of all postings are at
most ``HEAVY``, so they are broadcast; each other key has too few rows to make a
hot task.  Texts are shuffled once, by document.

Rows: a document is a row.  A null or empty text is one empty line.  Empty keys
are never dropped.  Repeated rows count as documents of their own.  A null key
column is a value like any other.  An empty table gives an empty result.  All
columns of the input are kept in ``row``, so no name can clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from merchantlens.session import scratch_path

#: The characters stripped from a line, and the letters lower-cased.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most this many keys are broadcast.
HEAVY = 10_000
HASH = ["h1", "h2"]
#: The database of the runs, so that none shows among the caller's tables.
DATABASE = "merchantlens_scratch"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashes(*of: Column) -> tuple[Column, Column]:
    return F.xxhash64(*of), F.xxhash64(F.lit(7), *of)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs: tables of (h1, h2, n_docs) under the session's shared folder.

    The driver holds only their names.  ``buckets`` is the number of sorted files
    of a run; it defaults to the number of shuffle partitions.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 2, buckets: int = 0):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: dict[int, list[str]] = {}
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {DATABASE}")

    def _write(self, counts: DataFrame, level: int) -> None:
        run = f"line_run_{level}_{uuid.uuid4().hex}"
        name = f"{DATABASE}.{run}"
        out = counts.select(*HASH, "n_docs").repartition(self.buckets, *HASH).write
        out = out.option("path", scratch_path(self.spark, run))
        out.bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name)
        self.levels.setdefault(level, []).append(name)

    def _merged(self, names: list[str]) -> DataFrame:
        runs = [self.spark.table(name) for name in names]
        while len(runs) > 1:
            runs = [a.unionAll(b) for a, b in zip(runs[::2], runs[1::2], strict=False)] + (
                runs[-1:] if len(runs) % 2 else []
            )
        return runs[0].groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"))

    def names(self) -> list[str]:
        return [name for level in sorted(self.levels) for name in self.levels[level]]

    def frequent(self) -> DataFrame | None:
        """Keys found in ``min_docs`` documents or more, None while there is no run."""
        if not self.names():
            return None
        return self._merged(self.names()).where(F.col("n_docs") >= self.min_docs)

    def add(self, postings: DataFrame) -> None:
        """Add a batch, one row (h1, h2) for each key of each document."""
        counts = postings.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"))
        settled = self.frequent()
        if settled is not None:
            counts = counts.join(settled.select(*HASH).hint("merge"), HASH, "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            names = self.levels.pop(level)
            self._write(self._merged(names), level + 1)
            for name in names:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1


def postings(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(d1, d2, h1, h2): one row for each distinct key of each document."""
    of_doc = _hashes(F.col(key), F.col(text))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col(text)), line_key), lambda k: k != ""))
    exploded = docs.select(of_doc[0].alias("d1"), of_doc[1].alias("d2"), F.explode(keys).alias("k"))
    found = _hashes(F.col("k"))
    return exploded.select("d1", "d2", found[0].alias("h1"), found[1].alias("h2"))


def dropped_keys(found: DataFrame, frequent: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """(d1, d2, drop): the frequent keys of each document that has any."""
    least = found.agg((F.count(F.lit(1)) / heavy).alias("least")).scalar()
    hot = F.broadcast(frequent.where(F.col("n_docs") > least).select(*HASH))
    rest = frequent.where(F.col("n_docs") <= least).select(*HASH)
    both = found.join(hot, HASH, "left_semi").unionAll(
        found.join(hot, HASH, "left_anti").join(rest, HASH, "left_semi")
    )
    return both.groupBy("d1", "d2").agg(F.collect_set(F.struct(*HASH)).alias("drop"))


def dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    min_docs: int = 10,
    batches: int = 4,
    fanout: int = 2,
) -> DataFrame:
    """``row`` (the input's columns), ``n_lines``, ``n_dropped`` and ``kept``.

    ``kept`` is the text without the lines whose key is in ``min_docs``
    documents or more.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "postings")
    found = postings(docs, text, key).withColumn("batch", F.pmod("d1", F.lit(batches)))
    found.write.partitionBy("batch").parquet(path)
    schema = "d1 long, d2 long, h1 long, h2 long, batch int"
    found = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        runs.add(found.where(F.col("batch") == batch).select(*HASH))
    drops = dropped_keys(found.drop("batch"), runs.frequent())

    of_doc = _hashes(F.col(key), F.col(text))
    rows = docs.select(F.struct("*").alias("row"), of_doc[0].alias("d1"), of_doc[1].alias("d2"))
    joined = rows.join(drops, ["d1", "d2"], "left")
    lines = _lines(F.col("row").getField(text))

    def stays(line: Column) -> Column:
        found = _hashes(line_key(line))
        return ~F.array_contains("drop", F.struct(found[0].alias("h1"), found[1].alias("h2")))

    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, stays))
    return joined.select("row", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept")).select(
        "row",
        "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
        F.array_join("kept", "\n").alias("kept"),
    )
