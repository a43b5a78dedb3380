"""Consistent sharding through a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: an
offset and a stride drawn from its name's hash.  The shards take turns; at its
turn a shard claims the first slot of its order that is still free.  The full
table gives every shard the same number of slots but for one, and losing a
shard moves few keys besides its own.  Filling is a matter of the shard list
alone (a table of a stated size); a row is then placed in constant time by its
key's hash and one broadcast lookup, in DataFrame operations only.

Keys that hold many rows can be spread: `spread` sends a key's rows to that
many slots by a hash of `spread_by`.

Defined cases: a null key is hashed as a text of its own; repeated rows go to
the same shard; an empty table gives an empty result; a table that has a
column named like `slot_col` or `shard_col` already is an error, whatever the
case of its letters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest table that is broadcast.
MAX_SLOTS = 1_048_573


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Offset and stride of a shard's order: the first two 32-bit words of its name's MD5."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that holds each slot."""
    if not is_prime(slots) or slots > MAX_SLOTS or slots < len(shards) or not shards:
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [preference(s, slots) for s in shards]
    upto, owner, left = [0] * len(shards), [-1] * slots, slots
    while True:
        for k, (offset, stride) in enumerate(orders):
            slot = (offset + upto[k] * stride) % slots
            while owner[slot] >= 0:
                upto[k] += 1
                slot = (offset + upto[k] * stride) % slots
            owner[slot] = k
            upto[k] += 1
            left -= 1
            if not left:
                return owner


def table(spark: SparkSession, shards: list[str], slots: int, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """The lookup table as a DataFrame made of one literal."""
    text = ",".join(map(str, fill_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias(slot_col, shard_col)).select(
        F.col(slot_col).cast("long"), F.col(shard_col).cast("int")
    )


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 32 bits of the MD5 of its text, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots


def assign(
    df: DataFrame,
    key_col: str,
    shards: list[str],
    slots: int = 65537,
    spread: int = 1,
    spread_by: str | None = None,
    slot_col: str = "slot",
    shard_col: str = "shard",
) -> DataFrame:
    """Adds the slot and the shard index of every row."""
    if clash := {c.lower() for c in df.columns} & {slot_col.lower(), shard_col.lower()}:
        raise ValueError(f"the table has {', '.join(sorted(clash))} already; name other columns")
    key = F.col(key_col).cast("string")
    if spread > 1:
        key = F.concat_ws("#", F.coalesce(key, F.lit("\u0000null")), F.pmod(F.xxhash64(spread_by or key_col), F.lit(spread)).cast("string"))
    lookup = table(df.sparkSession, shards, slots, slot_col, shard_col)
    return df.withColumn(slot_col, slot_of(key, slots)).join(F.broadcast(lookup), slot_col, "left")
