"""Packing documents into sequences: shortest pack first over the length histogram.

Documents are tokenized and cut at the sequence length.  Only the histogram of the piece lengths, at most one count
for each length, goes to the driver.  There lengths are placed longest first into the pack with the most room, many at a
time: what changes is the count of a packing pattern.  Each pattern then owns a range of ranks of every length it
holds, and a piece finds its sequence by its rank among the pieces of its length.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, running, stored, table
from .tokens import batches, crc, encoder, vocabulary

LENGTH = 1024
#: Pieces of text whose ids a worker remembers.
MEMORY = 400_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def patterns(histogram: dict[int, int], room: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the packing patterns for a histogram length -> number of pieces."""
    by_room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((r for r, packs in by_room.items() if packs and r >= length), default=None)
            if free is None:
                by_room[room - length].append((left, (length,)))
                break
            count, pack = by_room[free].pop()
            if count > left:
                by_room[free].append((count - left, pack))
            placed = min(count, left)
            by_room[free - length].append((placed, (*pack, length)))
            left -= placed
    return [x for packs in by_room.values() for x in packs]


def places(found: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """(length, rank, sequence, offset): pieces of this length from this rank on, up to the next row, go to sequences from
    ``sequence`` on, one each, at ``offset``."""
    rows, sequence, used = [], 0, defaultdict(int)
    for count, pack in found:
        offset = 0
        for length in pack:
            rows.append((length, used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int = LENGTH) -> DataFrame:
    """(doc_id, hash, start, length, ids_crc32, doc_tokens) of the pieces of docs (doc_id, text); whole texts, read once."""
    def cut(batch: pa.RecordBatch):
        encode, end = encoder(tokenizer, spaced=True, most=MEMORY), int(end_id).to_bytes(4, "little")
        for first in range(0, batch.num_rows, 1000):
            ids_, texts, hashes = (c.to_pylist() for c in batch.slice(first, 1000).columns)
            for doc_id, digest, ids in zip(ids_, hashes, encode(texts), strict=True):
                data = ids + end
                n = len(data) // 4
                for start in range(0, n, room):
                    piece = data[4 * start:4 * (start + room)]
                    yield [doc_id, digest, start, len(piece) // 4, crc(piece), n]

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("hash"))
    return rows.mapInArrow(batches(cut, _PIECES, encodes=True), "doc_id long, hash long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, room: int = LENGTH) -> DataFrame:
    """Places of all pieces of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    * Null texts are empty; every document ends with ``end_id``, so it has at least one piece.
    * Null and repeated ids are rows like any other; equal rows are interchangeable.  An empty table gives no rows.
    * On the driver: ``room`` counts, and patterns that grow with ``room`` only.  The place table goes to the tasks.
    """
    cut = stored(pieces(docs, tokenizer or vocabulary("byte_bpe_50k.json"), end_id, room), "pieces", TEXTS)
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    found = places(patterns(histogram, room))
    first, ranks = found["length"].to_numpy(), found["rank"].to_numpy()
    sequences, offsets = found["sequence"].to_numpy(), found["offset"].to_numpy()

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.empty(len(n), np.int64)
        for x in np.unique(n):
            low, high = np.searchsorted(first, x), np.searchsorted(first, x, side="right")
            mine = n == x
            at[mine] = low + np.searchsorted(ranks[low:high], r[mine], side="right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + r - ranks[at], "offset": offsets[at]})

    keyed = cut.withColumn("key", F.shiftrightunsigned(F.xxhash64("hash", "start"), 32))
    ranked = running(keyed, "length", "key", ["hash", "start", "doc_id"], F.lit(1), "rank")
    out = ranked.withColumn("at", place("length", F.col("rank").cast("long")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "at.sequence_id", "at.offset")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return pack(docs)
