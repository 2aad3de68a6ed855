"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: offset and
skip, both hashed from its name, walk through every slot. Shards take turns, and in its turn
a shard claims the first slot of its order that is still free, until the table is full. A
document's key hash modulo the table size names its slot, and the slot its shard: one
broadcast join with a table whose size is a parameter. Shards get nearly equal numbers of
slots (they differ by one at most), and when a shard leaves, few slots of the others change.

Defined cases: a null key is placed like any other value (it has a slot of its own choice of
hash); equal keys share a shard, so repeated rows stay together; an empty table stays empty;
texts are not looked at; columns of the input are kept, except that the result's ``slot`` and
``shard`` take the place of columns of these names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, require_columns

#: A prime, more than 100 times the number of shards.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> np.ndarray:
    """The number of the shard that holds each slot. ``size`` must be prime, so that every
    skip visits all slots, and no smaller than the number of shards."""
    if not _prime(size):
        raise ValueError(f"the table size must be prime, not {size}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    digests = [hashlib.sha256(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in digests]
    table = np.full(size, -1, dtype=np.int32)
    filled = 0
    while True:
        for shard in range(len(shards)):
            while table[at[shard]] >= 0:
                at[shard] = (at[shard] + skip[shard]) % size
            table[at[shard]] = shard
            filled += 1
            if filled == size:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str], size: int = TABLE_SIZE) -> DataFrame:
    """(slot, shard): the lookup table as a DataFrame of ``size`` rows."""
    table = lookup_table(shards, size)
    return spark.createDataFrame([(i, shards[t]) for i, t in enumerate(table.tolist())], "slot long, shard string")


def slot_of(key, size: int = TABLE_SIZE):
    """The slot of a key column: the first 60 bits of its MD5, modulo the table size."""
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def place(docs: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``. No shuffle: the table is broadcast, and its bound
    is the parameter ``size``."""
    prepare(docs.sparkSession)
    require_columns(docs, key)
    keyed = docs.withColumn("slot", slot_of(F.col(f"`{key}`"), size)).drop("shard")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("slot", "shard")]
    return keyed.join(F.broadcast(table_frame(docs.sparkSession, shards, size)), "slot").select(*kept, "slot", "shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: Sequence[str] = SHARDS,
                 size: int = TABLE_SIZE, files: int = 1) -> None:
    """Write the documents as one Parquet folder per shard. The rows of a shard are dealt by
    their slot over ``files`` files, so that a large shard isn't one task's work."""
    placed = place(docs, key, shards, size)
    placed.repartition("shard", F.col("slot") % files).write.partitionBy("shard").parquet(path)
