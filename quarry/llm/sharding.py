"""Shard placement by a permutation-filled lookup table (native)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

SHARDS, SLOTS = 64, 16381


def _preference(shard: str, slots: int) -> Iterator[int]:
    digest = md5(shard.encode()).digest()
    offset, step = int.from_bytes(digest[:8]) % slots, int.from_bytes(digest[8:]) % (slots - 1) + 1
    while True:
        yield offset
        offset = (offset + step) % slots


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the index of the shard that claimed it. slots must be prime: then each preference order visits every slot."""
    if slots < len(shards) or not shards or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime no smaller than the number of shards")
    orders, owner, left = [_preference(s, slots) for s in shards], [-1] * slots, slots
    while left:
        for k, order in enumerate(orders):
            slot = next(s for s in order if owner[s] < 0)
            owner[slot], left = k, left - 1
            if not left:
                break
    return owner


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with slot and shard; columns of these names are replaced. A null key goes by the empty string; equal keys go together.
    The table that is broadcast has one row per slot, so its size is a parameter."""
    owner = lookup(shards, slots)
    named = df.sparkSession.createDataFrame([(s, shards[k]) for s, k in enumerate(owner)], "slot long, shard string")
    slot = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("bigint") % slots
    return df.drop("shard").withColumn("slot", slot).join(F.broadcast(named), "slot")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return place(docs, F.col("doc_id"), [f"shard-{k:03d}" for k in range(SHARDS)]).select("doc_id", "slot", "shard")


def _plain(shards: int, slots: int) -> list[int]:
    """The lookup table, told plainly for the SQL: each shard's whole preference order, walked in turns."""
    orders = []
    for k in range(shards):
        n = int(md5(f"shard-{k:03d}".encode()).hexdigest(), 16)
        first, step = (n >> 64) % slots, (n & (2**64 - 1)) % (slots - 1) + 1
        orders.append([(first + i * step) % slots for i in range(slots)])
    table, at, k = {}, [0] * shards, 0
    while len(table) < slots:
        while orders[k][at[k]] in table:
            at[k] += 1
        table[orders[k][at[k]]] = k
        k = (k + 1) % shards
    return [table[s] for s in range(slots)]


def sql() -> str:
    return f"""
SELECT doc_id, slot, 'shard-' || lpad(([{", ".join(map(str, _plain(SHARDS, SLOTS)))}])[slot + 1]::VARCHAR, 3, '0') AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % {SLOTS} AS slot FROM documents)
"""
