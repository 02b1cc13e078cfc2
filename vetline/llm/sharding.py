"""Shard placement through a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table: a starting slot and a step drawn from its name. Shards take turns, each
claiming the first slot of its order that is still free, until the table is
full, so shares differ by one slot at most and a change of the shard list moves
few slots. A key hashes to a slot; the table, one row per slot, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vetline.llm.common import scratch, table

# The table size is prime and about a hundred times the shard count; its rows
# (two numbers and a name) bound the broadcast.
TABLE_SIZE, SHARDS = 6553, 64
MAX_TABLE_SIZE = 1_000_003


def _number(text: str) -> int:
    """First 32 bits of the MD5 digest."""
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Index of the shard that owns each slot."""
    if not 0 < len(set(shards)) == len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError("shards must be distinct, and at most as many as slots")
    if size < 2 or any(size % d == 0 for d in range(2, int(size ** 0.5) + 1)):
        raise ValueError("the table size must be prime")
    steps = [_number(f"step:{s}") % (size - 1) + 1 for s in shards]
    wants = [_number(f"start:{s}") % size for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i, step in enumerate(steps):
            slot = wants[i]
            while owner[slot] >= 0:
                slot = (slot + step) % size
            owner[slot], wants[i] = i, slot
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key of any type, by the MD5 of its text form; a null key has
    the slot of the empty text."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(size).cast("long"))


def placement(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE,
              slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """``df`` with the slot and shard of each row.

    Equal keys land on one shard, null keys on a fixed one; an empty input
    stays empty. Columns of the input named like an output are replaced.
    Nothing is shuffled: the table is a broadcast of ``size`` rows."""
    owners = ",".join(map(str, fill_table(shards, size)))
    names = F.array(*map(F.lit, shards))
    one = df.sparkSession.range(1)
    slots = one.select(F.posexplode(F.split(F.lit(owners), ",")).alias(slot_col, "owner")).select(
        F.col(slot_col).cast("long").alias(slot_col), F.element_at(names, F.col("owner").cast("int") + 1).alias(shard_col))
    placed = df.withColumn(slot_col, slot_of(F.col(key), size))
    if shard_col in placed.columns:
        placed = placed.drop(shard_col)
    return placed.join(F.broadcast(slots), slot_col).select(
        *[c for c in df.columns if c not in (slot_col, shard_col)], slot_col, shard_col)


def write_sharded(df: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE, salts: int = 8) -> None:
    """One Parquet folder per shard; ``salts`` tasks share the rows of a shard,
    so that a shard with a third of all rows is not one task's work."""
    placed = placement(df, key, shards, size)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts))
    placed.repartition("shard", salt).write.partitionBy("shard").parquet(path)


SHARD_NAMES = [f"shard-{i:03d}" for i in range(SHARDS)]


def sharded(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``df`` written by :func:`write_sharded` and read back: its columns, slot
    and the shard whose folder holds the row."""
    path = scratch(df.sparkSession, "shards")
    write_sharded(df, key, shards, path, size)
    return df.sparkSession.read.schema(placement(df.limit(0), key, shards, size).schema).parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), "doc_id", SHARD_NAMES).select("doc_id", "source", "slot", "shard")


def op4_sql() -> str:
    """Placement by plain SQL over the same table, spelled out as a list (the
    fill itself is held against a second implementation in the tests)."""
    owners = ",".join(map(str, fill_table(SHARD_NAMES)))
    return f"""
WITH d AS (
  SELECT doc_id, source,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {TABLE_SIZE} AS slot
  FROM documents)
SELECT doc_id, source, slot,
       'shard-' || lpad(string_split('{owners}', ',')[slot + 1], 3, '0') AS shard
FROM d
"""
