"""Sharding by jump consistent hashing (Lamping and Veach): no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key; the expected number of rounds is the logarithm of shards."""
    key = keys.astype(np.uint64)
    at, nxt = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        at[live] = nxt[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        nxt[live] = ((at[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[nxt[live] < shards]
    return at.astype(np.int32)


def shard_of(key: Column, shards: int) -> Column:
    """Int shard in [0, shards) of a column of any type; it depends on the key and the number of shards alone. A null key has a shard too."""

    @F.pandas_udf("int")
    def of(h: pd.Series) -> pd.Series:
        return pd.Series(jump(h.to_numpy().view(np.uint64), shards))

    return of(F.xxhash64(key))


def assign_shards(df: DataFrame, key: str, shards: int = 16, buckets: int = 1024) -> DataFrame:
    """df with shard, slot (gapless from 0 in each shard) and grown_shard (the shard if one more is appended).

    Slots are dealt in two steps so that no task holds a shard: rows are numbered within (shard, hash bucket of the
    row), and the buckets' first slots come from a table of at most shards * buckets counts, which is broadcast.
    Repeated rows get slots of their own. Columns of df named like the three added ones are replaced, others stay; a
    null key has a shard of its own choice like any other.
    """
    df = df.select(*[c for c in df.columns if c not in ("shard", "slot", "grown_shard")])
    free = lambda name: name if name not in df.columns else free(name + "_")
    bucket, own_, first_ = free("_bucket"), free("_own"), free("_first")
    order = [F.col(c) for c, kind in df.dtypes if c != key and not kind.startswith(("map", "variant"))]
    at = F.pmod(F.xxhash64(F.col(key), *order, F.lit("slot")), F.lit(buckets)).cast("int")
    placed = df.withColumns({"shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1), bucket: at})
    counts = df.select(shard_of(F.col(key), shards).alias("shard"), at.alias(bucket)).groupBy("shard", bucket).count()
    before = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", bucket, F.coalesce(F.sum("count").over(before), F.lit(0)).alias(first_))
    own = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(F.col(key), *order)) - 1
    return placed.withColumn(own_, own).join(F.broadcast(first), ["shard", bucket]).withColumn("slot", (F.col(first_) + F.col(own_)).cast("long")).drop(bucket, first_, own_)


def document_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard. A null text has size 1 and the checksum of no bytes, 0."""
    rows = documents.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    return assign_shards(rows, "doc_id", shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
