"""Sharding: a lookup table of prime size that shards fill by turns, in the order of their own permutations."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, at least a hundred times the number of shards for an even spread.
SLOTS = 65_537
#: The table is broadcast; its size is bounded by the number of slots, never by the data.
MAX_SLOTS = 4_194_301


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:7], "big")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of the shard that claimed it.

    Each shard has a permutation of the slots (offset + k * skip, slots being prime). Shards take turns; at
    its turn a shard claims the first free slot of its permutation. Slot counts differ by one at most, and
    when a shard comes or goes few slots move between those that stay."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be a non-empty list of distinct names")
    if not is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner = [-1] * slots
    free = slots
    while free:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            owner[at[i]] = i
            free -= 1
            if not free:
                break
    return owner


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 52 bits of the MD5 digest of its text, modulo the number of slots."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 13), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard (replaced if present, even if one of them is the key), found in constant time a row.

    Rows are placed by key alone, so repeated rows meet in one shard; a null key counts as the text "null".
    An empty table gives an empty one. No row is shuffled: the table is broadcast (slots rows, <= MAX_SLOTS)."""
    owner = lookup_table(shards, slots)
    lookup = df.sparkSession.createDataFrame([(i, shards[o]) for i, o in enumerate(owner)], "slot long, shard string")
    own = [f"`{c}`" for c in df.columns if c not in ("slot", "shard")]
    placed = df.select(*own, slot(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), slots).alias("slot"))
    return placed.join(F.broadcast(lookup), "slot").select(*own, "slot", "shard")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str], slots: int = SLOTS, splits: int = 16) -> None:
    """Writes a folder for each shard. A hot key is spread over `splits` tasks, by a hash of the whole row."""
    placed = place(df, key, shards, slots)
    salt = F.pmod(F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in df.columns]), F.lit(splits))
    placed.withColumn("_salt", salt).repartition("shard", "_salt").drop("_salt").write.mode("overwrite").partitionBy("shard").parquet(path)
