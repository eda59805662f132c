"""Sharding by a lookup table that the shards fill in turns, each by its own permutation."""

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import cleared

SLOTS = 65537
SHARDS = 64


def _number(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{purpose}:{name}".encode(), digest_size=8).digest())


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """For each of ``slots`` (a prime) the index of its shard.

    A shard prefers the slots ``offset, offset + skip, offset + 2 * skip, ...`` modulo the prime, which is a
    permutation. Shards take turns, in the order of their names, and claim the first free slot
    they prefer; so their shares differ by one slot at most, and when a shard comes or goes most
    slots keep theirs.
    """
    if slots < len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, and at least one for each shard")
    names = sorted(shards)
    offset = [_number(x, "offset") % slots for x in names]
    skip = [_number(x, "skip") % (slots - 1) + 1 for x in names]
    owner, upto = np.full(slots, -1, np.int32), [0] * len(names)
    for turn in range(slots):
        i = turn % len(names)
        while True:
            slot = (offset[i] + upto[i] * skip[i]) % slots
            upto[i] += 1
            if owner[slot] < 0:
                owner[slot] = i
                break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A key's slot: sixty bits of its md5 modulo the prime. A null key counts as an empty one."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(docs: DataFrame, shards: list[str] | None = None, slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``slot`` and ``shard``.

    The table has ``slots`` rows whatever the data, so it is broadcast; rows are placed where
    they are, without a shuffle. Equal keys go to one shard; keys are hashed, so that sources
    and groups of copies, whose ids differ, are spread over all shards.

    * A null key goes where an empty one goes.
    * Other columns are passed through, but for any named ``slot`` or ``shard``, which are replaced. An empty table gives an empty table.
    """
    docs = cleared(docs, "slot", "shard")
    names = sorted(shards or [f"shard-{i:05d}" for i in range(SHARDS)])
    owners = lookup_table(names, slots).tolist()
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, names[o]) for i, o in enumerate(owners)], "slot int, shard string")
    return docs.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(
        *docs.columns, "slot", "shard"
    )


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed rows to a folder per shard; a shard that is too large for one task is split into files."""
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
