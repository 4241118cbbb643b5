"""Sharding by a permutation-filled lookup table (operator 7), in DataFrame functions only.

Shards take turns to claim slots of a table of prime size, each in its own order of preference, until none is free.
A key's slot is its hash modulo the size; its shard stands there. The table is a literal of fixed size, so placing a
row takes a hash and a look, without a shuffle; when a shard leaves, few keys of the others move.

Defined results: a null key is placed like the empty string; equal keys go to one shard; a table without rows gives
none; other columns are kept, and where they have the names ``slot`` or ``shard`` the new ones get an underscore more.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime: slots of the table. The largest and smallest shares of n shards differ by one slot.
SLOTS = 4093
SHARDS = 16


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index in ``shards``. Shard s prefers the slots offset, offset + skip, offset + 2 skip ... modulo the size."""
    if not 0 < len(shards) <= slots:
        raise ValueError("there must be from one shard to as many as slots")

    def preferences(name: str):
        h = hashlib.md5(name.encode()).digest()
        at, skip = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:], "big") % (slots - 1) + 1
        while True:
            yield at
            at = (at + skip) % slots

    orders = [preferences(s) for s in shards]
    filled: dict[int, int] = {}
    while len(filled) < slots:
        for s, order in enumerate(orders):
            if len(filled) == slots:
                break
            slot = next(x for x in order if x not in filled)
            filled[slot] = s
    return [filled[i] for i in range(slots)]


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first 60 bits of the key's MD5, modulo the size."""
    head = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(slots)).cast("long")


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in map(str.lower, taken):
        name += "_"
    return name


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with slot (long) and shard (its index, long)."""
    table = F.lit(lookup_table(shards, slots))
    slot, shard = _free("slot", df.columns), _free("shard", df.columns)
    return df.withColumn(slot, slot_of(F.col(key), slots)).withColumn(shard, F.get(table, F.col(slot).cast("int")).cast("long"))


def op7(docs: DataFrame) -> DataFrame:
    return place(docs.select("doc_id"), "doc_id", shard_names())


def oracle() -> str:
    """DuckDB: the same hash, with the table as a list."""
    return f"""
    SELECT doc_id, slot, ({lookup_table(shard_names())})[slot + 1]::BIGINT AS shard
    FROM (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS})::BIGINT AS slot FROM documents)
    """
