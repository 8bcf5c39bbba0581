"""Placement of rows on shards by a permutation-filled lookup table.

Every shard has a preference order of the slots of a table of prime size. In turns, each shard claims the next slot
it prefers that is still free, until the table is full. A key is placed by one look at the slot it hashes to; when a
shard comes or goes, few other slots change hands.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TABLE_SIZE = 65_537
# Slots of the largest table: with it the lookup table is at most 4 million pairs of integers.
LARGEST = 4_000_037


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Owner of each slot, as a position in ``shards``; shards take their turns in the order of their names.

    The table's size is a parameter and does not grow with the data; it is filled before any row is read.
    """
    if not is_prime(size) or size > LARGEST:
        raise ValueError(f"table size must be a prime up to {LARGEST}: {size}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > size:
        raise ValueError("shards must be named differently, and be at least one and at most the table's size")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at = {i: _number(f"start:{shards[i]}") % size for i in turns}
    step = {i: _number(f"step:{shards[i]}") % (size - 1) + 1 if size > 2 else 1 for i in turns}
    owner, free = [-1] * size, size
    while True:
        for i in turns:
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + step[i]) % size
            owner[slot], at[i], free = i, (slot + step[i]) % size, free - 1
            if not free:
                return owner


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows: ``slot``, ``shard``."""
    owners = F.from_json(F.lit(str(fill_table(shards, size))), "array<int>")
    names = F.from_json(F.lit("[" + ",".join('"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in shards) + "]"), "array<string>")
    rows = spark.range(1).select(names.alias("names"), F.posexplode(owners).alias("slot", "owner"))
    return rows.select("slot", F.col("names")[F.col("owner")].alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key's text; a null key hashes like the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, key: Column, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` and ``shard``. Equal keys, and so repeated rows, get the same shard.

    The table, of fixed size, is broadcast; rows are not shuffled, so a hot key moves nothing here. Columns that
    have these names give way to the new ones.
    """
    lookup = F.broadcast(table_frame(docs.sparkSession, shards, size).withColumnRenamed("slot", "__slot").withColumnRenamed("shard", "__shard"))
    kept = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("slot", "shard")]
    rows = docs.select(*kept, slot_of(key, size).alias("slot"))
    return rows.join(lookup, F.col("slot") == F.col("__slot")).drop("__slot").withColumnRenamed("__shard", "shard")
