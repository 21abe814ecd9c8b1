"""Operator 3, sharding: a lookup table filled by permutations.

Every shard has a preference order over the slots of a table whose size is a
prime.  The shards take turns; each claims the first free slot of its order.
Shards then own equally many slots (the counts differ by one at most), and
losing a shard moves few slots of the others.  A row finds its shard by one
probe: hash of the key, modulo the size, into the broadcast table.

Rows: a null key counts as the empty text, so such rows meet in one shard;
repeated keys go to the same shard; an empty table gives an empty result;
other columns pass through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A prime; what is broadcast has exactly this many rows whatever the data hold.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{n:03d}" for n in range(64))


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The owner of each slot, as an index of ``shards``.

    A shard's order is ``offset + j * skip`` modulo ``size``, which visits every
    slot once since the size is a prime.
    """
    if not _is_prime(size) or not 0 < len(shards) <= size or len(set(shards)) < len(shards):
        raise ValueError("the size must be a prime and the shards distinct and no more than slots")
    place = [_number(name, "offset") % size for name in shards]
    skip = [_number(name, "skip") % (size - 1) + 1 for name in shards]
    owner, free = [-1] * size, size
    while free:
        for shard in range(len(shards)):
            while owner[place[shard]] >= 0:
                place[shard] = (place[shard] + skip[shard]) % size
            owner[place[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(size))


def lookup(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    rows = [(slot, shards[owner]) for slot, owner in enumerate(fill(shards, size))]
    return spark.createDataFrame(rows, "slot long, shard string")


def assign(
    df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE
) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; columns of these names are replaced."""
    table = F.broadcast(lookup(df.sparkSession, shards, size))
    kept = df.drop("slot", "shard") if key not in ("slot", "shard") else df
    placed = kept.select("*", slot_of(F.col(key), size).alias("slot"))
    return placed.join(table, "slot").select(*kept.columns, "slot", "shard")


def write(placed: DataFrame, path: str, files_per_shard: int = 1) -> None:
    """One folder per shard, with about ``files_per_shard`` files in each."""
    part = F.pmod(F.col("slot"), F.lit(files_per_shard))
    placed.repartition("shard", part).write.partitionBy("shard").parquet(path)
