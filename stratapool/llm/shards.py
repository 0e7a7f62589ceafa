"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table.

A row's shard depends on its key and the number of shards only. With one more shard, a row either
stays or moves into the new shard, and the necessary 1/(n+1) of the rows move.

Slots number a shard's rows from 0 without gaps, in the order (hash bucket of the key, key, size,
crc). Only keys, sizes and checksums are shuffled, never texts. Rows equal in all of these are
counted map-side first and unfolded at the end, so that a key with a third of all rows is one row
until then; no task holds a shard.

A null key is a key of its own; a null text has no bytes and checksum 0. Repeated rows get slots of
their own. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, prepare, running_offset

SHARDS = 24
ROW_OVERHEAD = 8
UNFOLD = 4096


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    key = keys.astype(np.uint64, copy=True)
    out = np.zeros(len(key), np.int64)
    at, live = np.zeros(len(key), np.int64), np.arange(len(key))
    while len(live):
        out[live] = at[live]
        k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        key[live] = k
        at[live] = ((at[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        live = live[at[live] < shards]
    return out


def with_shards(df: DataFrame, key_col: str, counts: dict[str, int]) -> DataFrame:
    """df and, for each name in counts, the int column of shards among so many. Python sees the key's hash only."""
    prepare(df.sparkSession)
    names = list(counts)

    @F.pandas_udf("struct<" + ", ".join(f"{n}: int" for n in names) + ">")
    def of(h):
        import pandas as pd

        keys = h.to_numpy().view(np.uint64)
        return pd.DataFrame({n: jump(keys, counts[n]).astype(np.int32) for n in names})

    got = df.withColumn("_jump", of(F.xxhash64(F.col(key_col))))
    return got.select(*[F.col(c) for c in df.columns if c not in names], *[F.col("_jump")[n].alias(n) for n in names])


def assign(docs: DataFrame, shards: int = SHARDS, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, grown_shard, slot) for each row; grown_shard: with one more shard."""
    text = F.col(text_col).cast("binary")
    rows = docs.select(
        F.col(key_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
    )
    folded = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    placed = with_shards(folded, "doc_id", {"shard": shards, "grown_shard": shards + 1})
    at = running_offset(placed, ["shard"], ["doc_id", "size", "text_crc32"], F.col("_n"), "_from")
    parts = at.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {UNFOLD}")))).repartition("shard", "_from", "_p")
    each = F.sequence(F.col("_p") * UNFOLD, F.least(F.col("_n"), (F.col("_p") + 1) * UNFOLD) - 1)
    return parts.withColumn("_i", F.explode(each)).select("doc_id", "size", "text_crc32", "shard", "grown_shard", (F.col("_from") + F.col("_i")).cast("long").alias("slot"))
