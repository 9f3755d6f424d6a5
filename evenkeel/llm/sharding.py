"""Placement of keys on shards through a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (an offset and a step taken from
hashes of its name). Shards take turns in claiming the next free slot of their order until the table is full, so their
shares differ by one slot at most, and a shard that leaves or joins moves few other slots. A key is hashed to a slot;
the table is broadcast, so placing a row is one lookup and needs no shuffle.

The table has ``slots`` rows, whatever the data (65,537 by default, below 1 MB), which bounds the broadcast and the
driver's work. Only DataFrame functions touch the data.

Cases: every row keeps its place in the result, repeated rows too; equal keys get equal shards; a NULL key has the hash
of NULL and thus one fixed shard; an empty table gives no rows; of further columns of the input, ``slot`` and ``shard``
are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
#: Shards of the registered query.
SHARDS = tuple(f"shard-{i:03d}" for i in range(96))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def filled(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The lookup table: for each slot the index of its shard in the sorted names."""
    names = sorted(set(shards))
    if not _is_prime(slots) or not 0 < len(names) <= slots:
        raise ValueError("the number of slots must be prime and at least the number of shards, and shards must exist")
    marks = [hashlib.sha256(name.encode()).digest() for name in names]
    at = [int.from_bytes(m[:8], "big") % slots for m in marks]
    step = [int.from_bytes(m[8:16], "big") % (slots - 1) + 1 for m in marks]
    owner = [-1] * slots
    free = slots
    while free:
        for shard in range(len(names)):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + step[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                break
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard)."""
    names = sorted(set(shards))
    rows = [(slot, names[owner]) for slot, owner in enumerate(filled(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def placed(rows: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``rows`` with the slot and shard of ``key``."""
    kept = rows.drop("slot", "shard")
    slot = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
    return kept.withColumn("slot", slot).join(F.broadcast(lookup(rows.sparkSession, shards, slots)), "slot", "left")
