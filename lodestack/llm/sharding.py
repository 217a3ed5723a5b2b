"""Jump consistent hashing of stable keys to shards.

The shard of a key follows from the key and the number of shards alone, without a ring table.
With one more shard a key either stays or moves into the new shard, and about one in n + 1 does.

Slots number the rows of each shard without gaps, in key order. They are found without gathering a
shard in one task: rows are dealt by key range, each range numbers its own rows of each shard, and
the ranges before it add their counts.

A null text has no bytes; a null key goes to a shard of its own choice like any other. A table without rows
gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

_MULTIPLIER = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard, 0 to ``shards`` - 1, of each 64-bit key."""
    state = keys.astype(np.uint64, copy=True)
    shard = np.zeros(len(keys), np.int64)
    target = np.zeros(len(keys), np.int64)
    live = np.arange(len(keys))
    while len(live):
        shard[live] = target[live]
        state[live] = state[live] * _MULTIPLIER + np.uint64(1)
        step = (1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        target[live] = ((shard[live] + 1) * step).astype(np.int64)
        live = live[target[live] < shards]
    return shard.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key column of any type: its 64-bit hash, jumped. A null key has a fixed shard too."""
    if shards < 1:
        raise ValueError("at least one shard")

    @F.arrow_udf("int")
    def jumped(hashes: pa.Array) -> pa.Array:
        return pa.array(jump_hash(np.asarray(hashes).astype(np.int64).view(np.uint64), shards))

    return jumped(F.xxhash64(key))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8; ``law`` is ``key``; ``grown_shard`` is the
    shard with one shard more. Rows of one key, repeated ones too, go to one shard and get a slot each.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    row = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    row = row.select(
        "*", shard_of(F.col("doc_id"), shards).alias("shard"), shard_of(F.col("doc_id"), shards + 1).alias("grown_shard")
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(row, "sharded").repartitionByRange(parts, "doc_id").withColumn("range", F.spark_partition_id())
    dealt = stage(dealt, "sharded")
    counts = dealt.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("slot", F.row_number().over(own) - 1)
        .join(offset, ["shard", "range"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
            (F.col("slot") + F.col("offset")).cast("long").alias("slot"), "grown_shard",
        )
    )
