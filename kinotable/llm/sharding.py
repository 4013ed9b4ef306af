"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a step from hashes of its name).
Shards take turns, each claiming the first slot of its order that is free, until the table is full; so shards get equal
numbers of slots, give or take one, and a change of shards moves few others. A document's hash names its slot. The table is
of fixed size whatever the data, goes to the executors once, and places each row by one lookup, without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinotable.llm import _text

SHARDS = tuple(f"shard-{k:02d}" for k in range(64))
#: A prime, over 100 times as large as the number of shards.
SLOTS = 65_537
#: Slots that a table may have, as it is broadcast.
MOST_SLOTS = 1 << 20


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:15], 16)


def lookup(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the shard of each slot."""
    if not shards or len(set(shards)) < len(shards) or not len(shards) < slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must be distinct and fewer than the slots, whose number must be a prime up to 2**20")
    at = [_hash(f"offset:{s}") % slots for s in shards]
    step = [_hash(f"step:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(min(len(shards), left)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key's text form; null is as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, key: str = "doc_id", keep: list[str] = (), shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """`keep` columns, slot and shard of each row of docs. Rows of equal key, repeated ones and null keys included, share a shard. Columns in `keep` may not be named as those added (an error). An empty table gives no rows."""
    if clash := {*keep} & {"slot", "shard"}:
        raise ValueError(f"names that place() adds itself: {sorted(clash)}")
    table = docs.sparkSession.createDataFrame([(k, shards[s]) for k, s in enumerate(lookup(shards, slots))], "slot long, shard string")
    rows = docs.select(*keep, slot_of(F.col(key), slots).alias("slot"))
    return rows.join(F.broadcast(table), "slot").select(*keep, "slot", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(_text.table(spark, sf_dir, "documents"), keep=["doc_id"])


def brute(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The table from written-out preference lists, one turn after the other, for tests and SQL."""
    lists = [iter([(_hash(f"offset:{s}") + j * (_hash(f"step:{s}") % (slots - 1) + 1)) % slots for j in range(slots)]) for s in shards]
    owner: dict[int, int] = {}
    for turn in range(slots):
        owner[next(x for x in lists[turn % len(shards)] if x not in owner)] = turn % len(shards)
    return [owner[k] for k in range(slots)]


def sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[:15])::BIGINT % {SLOTS} AS slot FROM documents),
t AS (SELECT unnest(range({SLOTS})) AS slot, unnest({brute()}) AS owner)
SELECT doc_id, slot, 'shard-' || lpad(owner::VARCHAR, 2, '0') AS shard FROM d JOIN t USING (slot)
"""


def __getattr__(name: str) -> str:
    if name == "SQL":
        return sql()
    raise AttributeError(name)
