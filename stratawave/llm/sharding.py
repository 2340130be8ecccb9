"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import digest, running, stored, table

ROUNDS = 4


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit mixing function; unsigned arithmetic wraps."""
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    return [int(x) for x in _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), seed % (1 << 64))]


def _once(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    """Permutation of [0, 4^half): each round swaps the halves and hides one behind a function of the other."""
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mixed(left, key) & mask), left
        else:
            left, right = right, left ^ (_mixed(right, key) & mask)
    return (left << shift) | right


def permuted(x: np.ndarray, n: int, seed: int = 1, back: bool = False) -> np.ndarray:
    """The place of each row number 0..n-1 in the shuffle; ``back`` gives the row number of a place.

    The Feistel network permutes the least power of four that holds n.  A number that leaves [0, n) walks on along its
    cycle until it is back inside: under four steps on average.
    """
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    keys = _keys(seed)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _once(out[todo], half, keys, back)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(row_number: int, n: int, n_shards: int, seed: int = 1) -> tuple[int, int]:
    """(shard, slot) of a row number, computed without the table."""
    p = int(permuted(np.array([row_number]), n, seed)[0])
    return p % n_shards, p // n_shards


def row_at(shard: int, slot: int, n: int, n_shards: int, seed: int = 1) -> int:
    """The row number at a place of a shard."""
    return int(permuted(np.array([slot * n_shards + shard]), n, seed, back=True)[0])


def shards(docs: DataFrame, n_shards: int = 8, seed: int = 1) -> DataFrame:
    """(doc_id, digest, size, text_crc32, row_number, shard, slot) of each row of docs (doc_id, text).

    * row_number: the row's global number, in the order of a hash of id and text; the number of rows is ``n``.  It is
      found by distributed prefix sums and does not depend on partitions.
    * The permuted number p gives shard p mod n_shards and slot p div n_shards: counts differ by one at most and slots
      have no gaps.
    * size: UTF-8 bytes of the text plus 1; null texts have no bytes.  Null and repeated ids are rows like any other;
      fully equal rows are interchangeable.  An empty table gives no rows.
    """
    key = F.xxhash64(F.lit(seed), "doc_id", "digest")
    slim = docs.select(
        "doc_id", digest(F.col("text")).alias("digest"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    slim = stored(slim.withColumn("hash", key).withColumn("key", F.shiftrightunsigned("hash", 32)).withColumn("all", F.lit(0)), "shards")
    n = slim.count()
    numbered = running(slim, "all", "key", ["hash", "doc_id", "digest"], F.lit(1), "row_number")

    @F.pandas_udf(T.LongType())
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(permuted(x.to_numpy(), n, seed))

    placed = numbered.withColumn("place", place(F.col("row_number").cast("long")))
    return placed.select(
        "doc_id", "digest", "size", "text_crc32", F.col("row_number").cast("long").alias("row_number"),
        (F.col("place") % n_shards).cast("int").alias("shard"), F.floor(F.col("place") / n_shards).cast("long").alias("slot"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
