"""Operator 8, n-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Documents with the same set form a class, and classes are joined.  Two sets of n and m
shingles link when they share at least ``needed(n, m)`` of them.

* Light sets, of no more than ``boundary`` shingles: for each size a partner may have, a
  set lists all its subsets of the needed size.  Two sets share one exactly if they link.
* Heavy sets scan inverted lists.  Shingles are ordered from rare to frequent, and two
  sets that link share one of their first n - (least needed) + 1.  Only lists of two
  classes or more are kept.

The boundary is the largest size whose subsets cost no more than the scan of its lists,
judged by the mean list length; the latter and the order come from one sketch, the number of
shingles in each of 65,536 hash ranges over all documents.  Its size is fixed.

Nothing lists all pairs of a group of near copies.  First each class meets its
``NEIGHBOURS`` next ones in each list, in an order by hash; a bitmap of each set bounds what two sets can
share and leaves hardly a false pair.  The links found give components.  Then, in each
list, only classes of different components still meet, and those outside the
list's largest component are the ones that scan.  They need not meet again in lists that
follow one they share, so pages of one template do not meet in each of its shingles.  All
pairs that link are covered: each meets in the first list it shares or is joined already.  Candidates are verified on the texts.

Shingles and sets are identified by 64-bit hashes.

Rows: a null or empty text, or one without words, has no shingles and links with
nothing; with fewer words than a shingle the whole sequence is one.  A row with a null
key links with nothing and has no component.  Rows with the same key are documents of
their own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from merchantlens.llm.frames import carried
from merchantlens.session import cut_lineage, discard

WIDTH, NUMERATOR, DENOMINATOR = 4, 85, 100
BUCKETS = 1 << 16
BITS = 512
LARGEST_LIGHT = 24
NEIGHBOURS = 4
#: How many lists back two classes are looked at for one in common.
EARLIER = 3
#: Rows of a list that one task sorts.
LIST_ROWS = 20_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``width`` words; sets link at ``numerator / denominator`` or more."""

    width: int = WIDTH
    numerator: int = NUMERATOR
    denominator: int = DENOMINATOR

    def needed(self, n: int, m: int) -> int:
        """How many of n and m elements must be shared."""
        return -(-self.numerator * (n + m) // (self.numerator + self.denominator))

    def sizes(self, n: int) -> range:
        """The sizes that a partner of a set of n elements may have."""
        least = -(-self.numerator * n // self.denominator)
        return range(least, self.denominator * n // self.numerator + 1)

    def prefix(self, n: int) -> int:
        return n - self.needed(n, self.sizes(n).start) + 1

    def subsets(self, n: int, boundary: int = LARGEST_LIGHT) -> int:
        return sum(comb(n, self.needed(n, m)) for m in self.sizes(n) if m <= boundary)

    def needed_column(self, n: Column, m: Column) -> Column:
        return F.ceil((n + m) * self.numerator / (self.numerator + self.denominator))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for at in range(size):
        mixed = (mixed ^ each[at : at + len(mixed)]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def identity(found: np.ndarray) -> int:
    """The class of a set."""
    return int.from_bytes(hashlib.md5(found.tobytes()).digest()[:8], "little", signed=True)


def bitmap(found: np.ndarray) -> list[int]:
    """For each of ``BITS`` residues whether an odd number of elements have it.

    Two bitmaps differ in no more bits than their sets differ in elements.
    """
    odd = np.bincount((found % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, n, cid, bits) of each document, and (bucket, count) of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, schema = np.zeros(BUCKETS, dtype=np.int64), None
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = shingles(text.as_py(), rule.width)
                rows.append((len(found), identity(found), bitmap(found)))
                counts += np.bincount((found >> np.uint64(48)).astype(np.int64), minlength=BUCKETS)
            nothing = pa.nulls(len(rows), pa.int64())
            n, cid, bits = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            out = pa.record_batch(
                {
                    "key": batch.column("key"),
                    "n": pa.array(n, pa.int32()),
                    "cid": pa.array(cid, pa.int64()),
                    "bits": pa.array(bits, pa.list_(pa.int64())),
                    "bucket": nothing.cast(pa.int32()),
                    "count": nothing,
                }
            )
            schema = out.schema
            yield out
        seen = np.flatnonzero(counts)
        if len(seen):
            empty = {name: pa.nulls(len(seen), schema.field(name).type) for name in schema.names}
            empty["bucket"] = pa.array(seen, pa.int32())
            empty["count"] = pa.array(counts[seen])
            yield pa.record_batch(empty)

    new = "n int, cid long, bits array<long>, bucket int, count long"
    schema = carried(docs, "key", new=new)
    nullable = T.StructField("key", schema["key"].dataType)  # the counts have no key
    return docs.mapInArrow(run, T.StructType([nullable, *schema.fields[1:]]))


def _listed(docs: DataFrame, rule: Rule, rank: np.ndarray, boundary: int) -> DataFrame:
    """(token, cid, n, pos) of what heavy pairs need; ``pos`` is -1 - (partner's size) for subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # classes of this partition
        for batch in batches:
            tokens, cids, sizes, places = [], [], [], []

            def add(cid: int, n: int, found: np.ndarray, pos: np.ndarray) -> None:
                tokens.append(found.view(np.int64))
                cids.append(np.full(len(found), cid))
                sizes.append(np.full(len(found), n, dtype=np.int32))
                places.append(pos.astype(np.int32))

            for text in batch.column("text"):
                found = shingles(text.as_py(), rule.width)
                n, cid = len(found), identity(found)
                if not n or cid in done:
                    continue
                done.add(cid)
                if rule.sizes(n)[-1] > boundary:
                    first = np.argsort(rank[found >> np.uint64(48)], kind="stable")[: rule.prefix(n)]
                    add(cid, n, found[first], np.arange(len(first)))
                if n <= boundary:
                    for m in rule.sizes(n):
                        # A pair of two such sizes that only equal sets can link needs no subset.
                        if m <= boundary and not (m == n == rule.needed(n, n)):
                            made = _subsets(found, rule.needed(n, m), min(n, m), max(n, m))
                            add(cid, n, made, np.full(len(made), -1 - m))
            if tokens:
                columns = [np.concatenate(c) for c in (tokens, cids, sizes, places)]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["token", "cid", "n", "pos"])

    return docs.select("text").mapInArrow(run, "token long, cid long, n int, pos int")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries of lists of two classes or more, and ``classes``; each is moved once.

    A list passes through one task, which writes to disk what it cannot hold.
    """
    of_list = Window.partitionBy("token")
    counted = entries.select(
        "*",
        F.count(F.lit(1)).over(of_list).alias("classes"),
        F.min("cid").over(of_list).alias("low"),
        F.max("cid").over(of_list).alias("high"),
    )
    return counted.where("low <> high").drop("low", "high").dropDuplicates(["token", "cid", "n", "pos"])


def _subsets(found: np.ndarray, size: int, *salt: int) -> np.ndarray:
    """A hash of each subset of a size, told apart by the two sizes of a pair."""
    spread = (found ^ (found >> np.uint64(31))) * _ODD
    start = np.uint64(salt[0] << 32 | salt[1]) * _ODD
    picked = np.array(list(combinations(range(len(found)), size)), dtype=np.int64)
    return np.unique((spread[picked].sum(axis=1, dtype=np.uint64) ^ start) * _ODD)


def _boundary(rule: Rule, counts: np.ndarray) -> int:
    """The largest size whose subsets cost no more than the scan of its lists."""
    total = counts.sum()
    if not total:
        return 0
    # The spread of the sketch's counts estimates the sum of squared frequencies.
    mean_list = max(1.0, float(((counts - counts.mean()) ** 2).sum() / total))
    fits = [n for n in range(1, LARGEST_LIGHT + 1) if rule.subsets(n, n) <= rule.prefix(n) * mean_list]
    return max(fits, default=0)


def _reach(rule: Rule, a: Column, b: Column) -> Column:
    """Whether two entries of a list can be a link by their sizes and places in the order."""
    needed = rule.needed_column(a["n"], b["n"])
    small, large = F.least(a["n"], b["n"]), F.greatest(a["n"], b["n"])
    sized = small * rule.denominator >= large * rule.numerator
    return sized & (F.least(a["n"] - a["pos"], b["n"] - b["pos"]) >= needed)


def _alike(rule: Rule, a: Column, b: Column) -> Column:
    """Whether two sets can be a link by their bitmaps."""
    needed = rule.needed_column(a["n"], b["n"])
    differ = sum(F.bit_count(F.get(a["bits"], i).bitwiseXOR(F.get(b["bits"], i))) for i in range(BITS // 64))
    return (a["n"] + b["n"] - differ) >= 2 * needed


def _heavy(boundary: int, a: Column, b: Column) -> Column:
    return F.greatest(a["n"], b["n"]) > boundary


def _next_ones(lists: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Candidates (a, b): each class of a list with the next ones; subsets with one of the other size."""
    entry = F.struct("cid", "n", "pos", "bits")
    # Long lists are cut by hash; pairs across the cuts come later.
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("classes") / LIST_ROWS))
    scanned = lists.where("pos >= 0").select("token", part.alias("part"), entry.alias("x"))
    # Another order in each list, so that a class meets others in each.
    order = Window.partitionBy("token", "part").orderBy(F.xxhash64("token", "x.cid"), "x.cid")
    next_ones = F.array(*[F.lead("x", k).over(order) for k in range(1, NEIGHBOURS + 1)])
    met = scanned.select("x", next_ones.alias("ys"))
    x = F.col("x")
    possible = F.filter(
        "ys", lambda y: y.isNotNull() & _heavy(boundary, x, y) & _reach(rule, x, y) & _alike(rule, x, y)
    )
    heavy = met.select("x.cid", F.explode(F.transform(possible, lambda y: y["cid"])).alias("b"))

    subsets = lists.where("pos < 0").withColumn("m", -1 - F.col("pos"))
    firsts = subsets.groupBy("token", "n", "m").agg(F.min("cid").alias("first"))
    firsts = firsts.select("token", F.col("n").alias("m"), F.col("m").alias("n"), "first")
    light = subsets.join(firsts, ["token", "n", "m"]).select("cid", F.col("first").alias("b"))
    return heavy.toDF("a", "b").unionAll(light.toDF("a", "b"))


def _size_band(rule: Rule, n: Column) -> Column:
    """Sets that link lie in the same band of sizes or in neighbouring ones."""
    width = math.log(rule.denominator / rule.numerator) * (1 + 1e-6)  # a little more, for rounding
    return F.floor(F.log(n.cast("double")) / width).cast("int")


def _met(lists: DataFrame, roots: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Pairs (a, b) of one list but different components, by sizes and places.

    Entries meet if their sizes lie in neighbouring bands; long lists are cut into parts,
    and each pair of parts is a key of its own.  A pair that links needs to meet in the
    first list that it shares only: two entries whose classes had a list in common shortly
    before have met there or earlier, and a list all of whose entries come from the same
    one is left out.
    """
    scanned = lists.where("pos >= 0").select("token", "cid", "n", "pos").join(roots, "cid", "left")
    scanned = scanned.withColumn("root", F.coalesce("root", "cid"))
    by_root = scanned.groupBy("token", "root").agg(F.count(F.lit(1)).alias("rows"))
    main = by_root.groupBy("token").agg(
        F.max_by("root", "rows").alias("main"), F.count(F.lit(1)).alias("roots"), F.sum("rows").alias("length")
    )
    scanned = scanned.join(main.where("roots > 1").drop("roots"), "token")
    of_class = Window.partitionBy("cid").orderBy("pos")
    before = F.array(*[F.lag("token", k).over(of_class) for k in range(1, EARLIER + 1)])
    scanned = scanned.withColumn("before", F.array_compact(before))
    last = F.get("before", F.lit(0))
    came = scanned.groupBy("token").agg(
        F.min(last).alias("low"), F.max(last).alias("high"), F.count_if(last.isNull()).alias("first")
    )
    scanned = scanned.join(came.where("first > 0 OR low <> high").select("token"), "token")
    parts = F.ceil(F.col("length") / LIST_ROWS).cast("int")
    scanned = scanned.select(
        "token",
        F.struct("cid", "n", "pos", "root", "main", "before").alias("entry"),
        _size_band(rule, F.col("n")).alias("band"),
        F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"),
        F.sequence(F.lit(0), parts - 1).alias("parts"),
    )
    near = F.array(*[F.col("band") + step for step in (-1, 0, 1)])
    left = scanned.where("entry.root <> entry.main").select(
        "token", F.col("entry").alias("x"), F.explode(near).alias("band"), F.col("part").alias("mine"), "parts"
    ).select("token", "x", "band", "mine", F.explode("parts").alias("theirs"))
    right = scanned.select(
        "token", F.col("entry").alias("y"), "band", F.col("part").alias("theirs"), F.explode("parts").alias("mine")
    )
    x, y = F.col("x"), F.col("y")
    apart = (x["root"] != y["root"]) & ((y["root"] == y["main"]) | (x["cid"] < y["cid"]))
    met = left.join(right, ["token", "band", "mine", "theirs"])
    met = met.where(apart & ~F.arrays_overlap(x["before"], y["before"]) & _heavy(boundary, x, y) & _reach(rule, x, y))
    return met.select(x["cid"].alias("a"), y["cid"].alias("b"))


def _across(lists: DataFrame, roots: DataFrame, classes: DataFrame, rule: Rule, boundary: int) -> DataFrame:
    """Candidates (a, b) of one list but different components.

    Few lists still hold two components, so only numbers are moved to find them; bitmaps
    are fetched for the pairs that are left.
    """
    pairs = _met(lists, roots, rule, boundary).distinct()
    for end in ("a", "b"):
        told = classes.select(F.col("cid").alias(end), F.struct("n", "bits").alias(f"of_{end}"))
        pairs = pairs.join(told, end)
    return pairs.where(_alike(rule, F.col("of_a"), F.col("of_b"))).select("a", "b")


def _verified(candidates: DataFrame, rows: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The candidates that link; only texts of their classes are read and moved."""
    pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut_lineage(pairs.where("a <> b").distinct())
    involved = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    involved = involved.join(classes.select("cid", F.col("first").alias("key")), "cid")
    # Each text is moved once to its class; both sides of a pair then read that.
    texts = _of_class(rows.join(involved, "key").select("cid", "text"), rule)
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for one, other in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                p, q = shingles(one.as_py(), rule.width), shingles(other.as_py(), rule.width)
                shared = len(np.intersect1d(p, q, assume_unique=True))
                links.append(shared >= rule.needed(len(p), len(q)))
            yield batch.select(["a", "b"]).filter(pa.array(links, pa.bool_()))

    links = cut_lineage(both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long"))
    discard(pairs)
    return links


def _to_roots(low: DataFrame) -> DataFrame:
    """(cid, up) with every id led to the end of its way, which only goes down; by doubling."""
    moved = True
    while moved:
        further = low.join(low.toDF("up", "top"), "up", "left")
        found = cut_lineage(further.select("cid", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        discard(low)
        moved = not found.where("moved").isEmpty()
        low = found.select("cid", "up")
    return low


def components(links: DataFrame) -> DataFrame:
    """(cid, root): one id for all ids that links join, for every id that has a link.

    Each round leads an id to its smallest neighbour, that one to its own and so on to the
    end, and replaces the links by those between the ends; links within a component
    disappear.  An id that is not smaller than all its neighbours is no end, so a round
    leaves at most half of the ids: with n ids there are at most log2(n) rounds of at most
    log2(n) doublings.  What a round has written is removed when the next one has read it.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges.where("a <> b"))
    ids = edges.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    roots = cut_lineage(ids.withColumn("root", F.col("cid")))
    while not edges.isEmpty():
        low = _to_roots(cut_lineage(edges.groupBy("b").agg(F.min("a").alias("up")).toDF("cid", "up")))
        told = roots.join(low.toDF("root", "up"), "root", "left")
        told = cut_lineage(told.select("cid", F.coalesce("up", "root").alias("root")))
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(low.toDF(end, "up"), end, "left").withColumn(end, F.coalesce("up", end)).drop("up")
        ends = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        ends = cut_lineage(ends.distinct())
        discard(edges, roots, low)
        edges, roots = ends, told
    discard(edges)
    return roots


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule = Rule()) -> DataFrame:
    """The key, ``n_shingles`` and ``component_id`` (the smallest key reachable) of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    told = cut_lineage(_describe(rows, rule))
    sketch = np.zeros(BUCKETS, dtype=np.int64)
    for row in told.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")).collect():
        sketch[row.bucket] = row["count"]
    rank = np.empty(BUCKETS, dtype=np.int32)
    rank[np.argsort(sketch, kind="stable")] = np.arange(BUCKETS, dtype=np.int32)
    boundary = _boundary(rule, sketch)

    described = told.where("bucket IS NULL").drop("bucket", "count")
    classes = described.where("key IS NOT NULL AND n > 0").groupBy("cid").agg(
        F.min("key").alias("first"), F.any_value("n").alias("n"), F.any_value("bits").alias("bits")
    )
    entries = _listed(rows.where("key IS NOT NULL"), rule, rank, boundary)
    lists = cut_lineage(_shared(entries).join(classes.select("cid", "bits"), "cid"))

    links = _verified(_next_ones(lists, rule, boundary), rows, classes, rule)
    roots = components(links)
    more = _verified(_across(lists, roots, classes, rule, boundary), rows, classes, rule)
    if not more.isEmpty():
        again = components(links.unionAll(more))
        discard(roots)
        roots = again
    discard(lists, links, more)

    first = classes.join(roots, "cid", "left").select(
        "cid", F.coalesce("root", "cid").alias("root"), "first"
    )
    lowest = first.groupBy("root").agg(F.min("first").alias("component_id"))
    of_class = first.join(lowest, "root").select("cid", "component_id")
    joined = described.join(of_class, "cid", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return joined.select(
        F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")
    )


def _of_class(found: DataFrame, rule: Rule) -> DataFrame:
    """One text of each class: rows that share a key with another text are told apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("cid"), batch.column("text"), strict=True)
            fits = [identity(shingles(t.as_py(), rule.width)) == c.as_py() for c, t in pairs]
            yield batch.filter(pa.array(fits, pa.bool_()))

    return found.mapInArrow(run, "cid long, text string").dropDuplicates(["cid"])


def first_of_each(
    docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule = Rule(), unkeyed: bool = False
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the smallest key stays.

    A row is told by its key and text, so one of several rows with a key can stay; rows
    equal in both stay once.  Rows with a null key stay, or, if ``unkeyed``, are compared
    like all others and come after every key.
    """
    of_row = F.col(key), F.col(text)
    own = F.struct(
        F.col(key).isNull().alias("unkeyed"),
        F.col(key).alias("key"),
        F.xxhash64(*of_row).alias("h1"),
        F.xxhash64(F.lit(7), *of_row).alias("h2"),
    )
    # Of the type that it has when it is read back; else rows would be moved again to be joined.
    fields = docs.select(own.alias("id")).schema["id"].dataType.fields
    own = own.cast(T.StructType([T.StructField(field.name, field.dataType) for field in fields]))
    known = own if unkeyed else F.when(F.col(key).isNotNull(), own)
    rows = docs.select(F.struct("*").alias("row"), known.alias("id"), F.col(text).alias("text"))
    found = join(rows, "text", "id", rule)
    stays = found.where(F.col("id") == F.col("component_id")).select(F.col("id").alias("stays")).distinct()
    # Equal rows are combined first, so no id is hot in the join.
    told = rows.where("id IS NOT NULL").select("row", "id").dropDuplicates(["id"])
    told = told.join(stays, F.col("id") == F.col("stays"), "left_semi")
    return told.unionByName(rows.where("id IS NULL").select("row", "id")).select("row.*")
