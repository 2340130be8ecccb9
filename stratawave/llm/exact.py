"""Exact dedup by deterministic block naming.

A text is cut into blocks of fixed size.  The distinct blocks of all documents are sorted and numbered; the number
is a block's name.  Then adjacent names are named as pairs in the same way, again and again, until each text has one
name.  Two texts of the same length have the same name if and only if they are equal: no step relies on a hash being
free of collisions.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_rows, stored, table
from .tokens import batches

BLOCK = 2048

_BLOCKS = pa.schema([("hash", pa.int64()), ("block", pa.binary())])
_PLACES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.string()), ("sha", pa.string()), ("n_bytes", pa.int64()), ("pos", pa.int64()), ("hash", pa.int64()), ("block", pa.binary())])


def _signed(block: bytes) -> int:
    x = xxhash.xxh64_intdigest(block)
    return x - (1 << 64) if x >> 63 else x


def _cut(text: str | None, size: int) -> list[bytes]:
    """Blocks of the text with A-Z in lower case; the empty text is one empty block."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # lower() of bytes changes A-Z only
    return [data[i:i + size] for i in range(0, len(data), size)] or [b""]


def _names(keys: DataFrame, order: list[str], label: str) -> DataFrame:
    """A number for each row of distinct ``keys``, in their sorted order."""
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn("name", F.monotonically_increasing_id()), label)


def block_names(docs: DataFrame, block: int) -> tuple[DataFrame, bool]:
    """(hash, block, name) of the distinct blocks; ``block`` is null where its hash belongs to no other block.

    Blocks meet by hash, each kind once for each map task; blocks with equal hashes are told apart by their bytes.
    """
    def cut(batch: pa.RecordBatch):
        seen = set()
        for text in batch.column(0).to_pylist():
            for b in _cut(text, block):
                h = _signed(b)
                if (h, b) not in seen:
                    seen.add((h, b))
                    yield [h, b]

    found = docs.select("text").mapInArrow(batches(cut, _BLOCKS, 5_000), "hash long, block binary")
    kinds = found.groupBy("hash").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    kinds = stored(kinds.select("hash", F.posexplode("blocks").alias("nth", "block"), (F.size("blocks") > 1).alias("shared"))
                   .select("hash", "nth", F.when(F.col("shared"), F.col("block")).alias("block")), "exact-blocks")
    names = _names(kinds, ["hash", "nth"], "exact-names").select("hash", "block", "name")
    return names, bool(names.filter("block IS NOT NULL").limit(1).count())


def identities(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, doc_id, digest, sha, n_bytes, name) of each row of docs (doc_id, text); (n_bytes, name) is its text's identity.

    * Texts are compared with A-Z in lower case; null counts as empty.
    * Very long texts are many blocks: a text of k blocks takes log2(k) rounds, in which only such texts take part.
    """
    names, shared = block_names(docs, block)

    def cut(batch: pa.RecordBatch):
        for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            raw = (text or "").encode("utf-8", "surrogatepass")
            blocks = _cut(text, block)
            md5, sha, n = hashlib.md5(raw).hexdigest(), hashlib.sha256(raw.lower()).hexdigest(), len(raw)
            for pos, b in enumerate(blocks):
                yield [row, doc_id, md5, sha, n, pos, _signed(b), b if shared else None]

    places = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(
        batches(cut, _PLACES), "row long, doc_id long, digest string, sha string, n_bytes long, pos long, hash long, block binary")
    if shared:
        known = names.withColumnRenamed("block", "_block")
        met = places.join(known, "hash").filter("_block IS NULL OR _block = block").drop("_block", "block")
    else:
        met = places.drop("block").join(names.drop("block"), "hash")
    level = stored(met.drop("hash"), "exact-places")
    done = level.filter(F.col("n_bytes") <= block).drop("pos")
    rest = level.filter(F.col("n_bytes") > block)
    last = rest.agg(F.max("pos")).first()[0]
    size = block
    while last:
        size *= 2
        ids = ["row", "doc_id", "digest", "sha", "n_bytes"]
        pairs = rest.groupBy(*ids, F.floor(F.col("pos") / 2).cast("long").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = stored(pairs, "exact-pairs")
        named = _names(pairs.select("left", "right").distinct(), ["left", "right"], "exact-names")
        rest = stored(pairs.join(named, ["left", "right"]).drop("left", "right"), "exact-places")
        done = done.unionByName(rest.filter(F.col("n_bytes") <= size).drop("pos"))
        rest = rest.filter(F.col("n_bytes") > size)
        last = rest.agg(F.max("pos")).first()[0]
    return done


def duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, keep_id, group_size, kept, text_sha256) of each row of docs (doc_id, text).

    Of equal texts the row with the largest doc_id stays, null being the smallest; of repeated ids exactly one row stays.
    Empty and null texts form one group.  An empty table gives no rows.
    """
    rows = stored(identities(docs, block), "exact-rows")
    first = F.struct(F.col("doc_id").isNotNull().alias("some"), F.col("doc_id"), F.col("row"))
    # Stored, so that the join below reads two plain tables and a hot group can be split.
    groups = stored(rows.groupBy("n_bytes", "name").agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    joined = rows.join(groups, ["n_bytes", "name"])
    return joined.select(
        "doc_id", "digest", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("sha").alias("text_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents")).drop("digest")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    kept = duplicates(docs).filter("kept").select("doc_id", "digest", F.lit(1).alias("copies"))
    return keep_rows(docs, kept)


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
n AS (
  SELECT doc_id, norm, row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) AS nth FROM d)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       nth = 1 AS kept, sha256(norm) AS text_sha256
FROM n
"""
