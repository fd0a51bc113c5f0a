"""
Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. The shards take turns and
each claims the first slot of its permutation that is still free, a shard of weight w doing so w times
a turn. A key is hashed to a slot and goes to the shard that claimed it: one lookup, near-even
shares, and few keys move when a shard comes or goes.

The table has ``size`` rows whatever the data, so it is broadcast; nothing else moves.

Defined results: a null key is a key of its own; equal keys go to the same shard; an empty table gives an
empty result; all columns are kept, and ``slot`` and ``shard`` are added in place of any of that name.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537  # prime
LARGEST = 10_000_019  # bounds what is broadcast


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{text}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str] | dict[str, int], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot, the number of the shard (in the order given) that claimed it."""
    weights = dict(shards) if isinstance(shards, dict) else dict.fromkeys(shards, 1)
    if not weights or len(weights) != len(shards) or min(weights.values()) < 1:
        raise ValueError("Shards need different names and weights of 1 or more.")
    if not _prime(size) or not sum(weights.values()) <= size <= LARGEST:
        raise ValueError(f"The table size must be a prime from the sum of weights to {LARGEST}.")
    start = [_number(s, "offset") % size for s in weights]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in weights]
    turns = list(weights.values())
    table = np.full(size, -1, np.int32)
    asked = [0] * len(turns)
    claimed = 0
    while True:
        for shard, times in enumerate(turns):
            for _ in range(times):
                slot = (start[shard] + asked[shard] * skip[shard]) % size
                while table[slot] >= 0:
                    asked[shard] += 1
                    slot = (start[shard] + asked[shard] * skip[shard]) % size
                table[slot] = shard
                asked[shard] += 1
                claimed += 1
                if claimed == size:
                    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table size."""
    text = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint") % F.lit(size)


def assign(rows: DataFrame, key: str, shards: list[str] | dict[str, int], size: int = TABLE_SIZE) -> DataFrame:
    """All rows with the ``slot`` and ``shard`` of their key."""
    names = list(shards)
    table = rows.sparkSession.createDataFrame(
        [(i, names[s]) for i, s in enumerate(lookup_table(shards, size).tolist())], "_slot bigint, _shard string")
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("slot", "shard")]
    slots = rows.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    # As many rows as the table has slots, a fixed parameter.
    return slots.join(F.broadcast(table), F.col("slot") == F.col("_slot")).withColumnRenamed(
        "_shard", "shard").drop("_slot")
