"""Operator 12: shards by jump consistent hashing of stable keys, and gapless slots in each shard.

A document's key is its doc_id as decimal text; 60 bits of the key's MD5 seed the jump sequence. The shard depends on key
and shard count alone (law `key`): no ring table, and of n + 1 shards the last takes its rows from all others, which keep
the rest. Nothing else of a row matters: equal texts under different ids may lie in different shards, and all rows of one
doc_id (a null doc_id is the key 'null') lie in one, however many they are.

A row's slot is its place in its shard in ascending order of doc_id (nulls first), then CRC and size of the text; equal
rows take neighbouring slots. Null text is of size 1 and has the CRC of the empty text. Other columns are ignored. An
empty table gives no rows.

Plan: one pass over the texts leaves light rows (ids, size, CRC), and only the keys' seeds, 8 bytes a row, go to Python
in Arrow batches, where the jumps of a whole batch are taken at once. Slots come from one range exchange of light rows by
(shard, doc_id, ...): a shard spans as many tasks as its rows need, so neither a hot key nor the small number of shards
limits the work; the driver sees one count a range and one row a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.operators.ranks import ascending, numbered

#: Fixed value: the multiplier of the published jump sequence.
STEP = 2862933555777941757


def jump(seeds: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each seed, below `shards`; a seed's expected number of jumps is the logarithm of `shards`."""
    key, at, ahead = seeds.astype(np.uint64), np.zeros(len(seeds), np.int64), np.zeros(len(seeds), np.float64)
    going = np.arange(len(seeds))
    while len(going):
        at[going] = ahead[going].astype(np.int64)
        key[going] = key[going] * np.uint64(STEP) + np.uint64(1)  # wraps at 64 bits
        ahead[going] = np.floor((at[going] + 1) * (float(1 << 31) / ((key[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        going = going[ahead[going] < shards]
    return at.astype(np.int32)


def seed_of(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long")


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key among `shards`, as an int column."""
    if shards < 1:
        raise ValueError("there must be one shard at least")

    @F.pandas_udf("int")
    def of(seeds: pd.Series) -> pd.Series:
        return pd.Series(jump(seeds.to_numpy(), shards))

    return of(seed_of(key))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of docs (doc_id, text, ...).

    size: UTF-8 bytes of the text plus 1; grown_shard: the shard among one more; slot: from 0 without gaps in each shard.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    light = docs.select(
        "doc_id",
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    placed = numbered(light, ["shard"], ascending("doc_id", "text_crc32", "size"), "__slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("__slot") - 1).alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Every column of docs in one folder a shard, shard=0, shard=1, ...; a shard is written by as many tasks as held its rows."""
    docs.withColumn("shard", jump_shard(F.col("doc_id"), shards)).write.partitionBy("shard").mode("overwrite").parquet(path)
