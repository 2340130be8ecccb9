"""Near-dedup by the Jaccard similarity of five-word shingles.

Two documents link at a similarity of 0.8 or more.  First come the pairs whose SimHash fingerprints link; at 0.8 two
fingerprints differ in about 10 of 64 bits, so they are only the closest.  The other candidates share a band: 4 of 96
minima of the shingles' hashes are equal.  A pair at similarity s shares one of the 24 bands with probability
1 - (1 - s^4)^24, which is 0.999997 at 0.8.  Every candidate is verified with the exact sets of hashes, so no link is
below 0.8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, components, ends, keep_rows, stored
from .tokens import batches

SEED, WORDS = 42, 5
#: The least similarity is LEAST[0] / LEAST[1].
LEAST = (4, 5)
BANDS, MINIMA = 24, 4
#: The sets of a band are compared with PIVOTS of them first; parts that remain are compared by sketches, and by sharper keys too if the band has more than CROWD.
CROWD, PIVOTS = 512, 2
#: Sharper keys: 10 of 640 minima.  A pair at 0.8 shares one of the 64 with probability 0.9993, one at 0.4 with 0.007.
SHARP_BANDS, SHARP_MINIMA = 64, 10
#: Four bits of each of the 640 minima, as 64-bit words.  At 0.8 they differ in 256 bits with a deviation of 23, so a
#: pair that differs in more than 360 is below 0.8 (4.5 deviations).
#: The first 8 words alone differ in 51 bits with a deviation of 10.4; beyond 98 the rest need not be looked at.
SKETCH, MOST_BITS = SHARP_BANDS * SHARP_MINIMA // 16, 360
START, MOST_START = 8, 98


def _mixers(n: int, seed: int) -> np.ndarray:
    return np.array([[xxhash.xxh64_intdigest(b"%d" % i, s) for i in range(n)] for s in (seed, seed + 1)], np.uint64) | np.array([[0], [1]], np.uint64)


_MIX, _SHARP = _mixers(BANDS * MINIMA, 1), _mixers(SHARP_BANDS * SHARP_MINIMA, 3)
_ROWS = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("node", pa.int64()), ("n", pa.int32()), ("print", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SHARPER = pa.schema([("node", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
_SETS = pa.schema([("node", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def shingles(text: str | None) -> np.ndarray:
    """The distinct hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return np.array([h(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-WORDS] + 1])
    return np.unique(np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1:].tolist(), strict=True)), np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The SimHash fingerprint: bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 16_384):
        counts += np.unpackbits(hashes[i:i + 16_384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(counts * 2 > len(hashes))))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_of(hashes: np.ndarray) -> int:
    """Name of a set of shingles."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).astype(np.int64))


def minima_of(hashes: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that is not empty."""
    least = np.full(mix.shape[1], np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[i:i + 256, None] ^ mix[0]) * mix[1]).min(axis=0), out=least)
    return least


def named_bands(least: np.ndarray, minima: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(-1, minima))], np.uint64).view(np.int64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of each band; none for an empty set."""
    return named_bands(minima_of(hashes, _MIX), MINIMA) if len(hashes) else np.zeros(0, np.int64)


def sketch_of(least: np.ndarray) -> np.ndarray:
    low = (least & np.uint64(15)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, node, n, print, keys) of each row of docs (doc_id, text), whole texts; n: shingles of the set,
    print: its fingerprint."""
    def make(batch: pa.RecordBatch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = shingles(text)
            yield [doc_id, hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest(), node_of(x), len(x), signed(majority(x)), band_keys(x)]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches(make, _ROWS), "doc_id long, digest string, node long, n int, print long, keys array<long>")


def _fits(a: str, b: str) -> Column:
    """Whether the numbers of shingles allow the least similarity."""
    return F.least(a, b) * LEAST[1] >= F.greatest(a, b) * LEAST[0]


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def texts_of(nodes: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """One text of each set (node)."""
    firsts = rows.join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    named = firsts.select("first.doc_id", "first.digest", F.lit(1).alias("copies")).distinct()
    return keep_rows(docs.select("doc_id", "text"), named).select("text")


def verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that reach the least similarity; only the texts of these sets are read again."""
    def make(batch: pa.RecordBatch):
        for text in batch.column(0).to_pylist():
            x = shingles(text)
            yield [node_of(x), x.view(np.int64)]

    texts = texts_of(ends(pairs), rows, docs)
    sets = stored(texts.mapInArrow(batches(make, _SETS), "node long, hashes array<long>"), "shingle-sets")
    sets = sets.dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared * (LEAST[0] + LEAST[1]) >= (F.size("x") + F.size("y")) * LEAST[0]).select("a", "b")


def _alike() -> Column:
    """Whether two sets (node, n, part, sketch) and (other, m, other_part, other_sketch) may reach the least similarity."""
    def bits(words: int) -> Column:
        return reduce(Column.__add__, (F.bit_count(F.get("sketch", F.lit(i)).bitwiseXOR(F.get("other_sketch", F.lit(i)))) for i in range(words)))

    apart = (F.col("node") < F.col("other")) & (F.col("part") != F.col("other_part"))
    return apart & _fits("n", "m") & (bits(START) <= MOST_START) & (bits(SKETCH) <= MOST_BITS)


def _compared(keyed: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (key, node, n, part, sketch, all, met) of different parts that share a key and have like sketches.

    ``all`` are the keys of the set; a pair is made at the least key that both have, so it is one row.  Pairs that have
    one of ``met`` in common were made elsewhere.
    """
    # A number of partitions of its own: few rows may make many comparisons, so small partitions must not be put together.
    keyed = keyed.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    other = keyed.select(F.col("key").alias("same"), F.col("node").alias("other"), F.col("n").alias("m"), F.col("part").alias("other_part"), F.col("sketch").alias("other_sketch"), F.col("all").alias("other_all"), F.col("met").alias("other_met"))
    once = ~F.arrays_overlap("met", "other_met") & (F.array_min(F.array_intersect("all", "other_all")) == F.col("key"))
    return keyed.join(other, (F.col("key") == F.col("same")) & _alike() & once).select(*_ordered("node", "other"))


def across(left: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different parts that have like sketches and share a band (key, node, n, count, part), or a
    sharper key where the band has more than ``CROWD`` sets."""
    def make(batch: pa.RecordBatch):
        for text in batch.column(0).to_pylist():
            x = shingles(text)
            if len(x):
                least = minima_of(x, _SHARP)
                yield [node_of(x), named_bands(least, SHARP_MINIMA), sketch_of(least)]

    met = F.collect_list(F.when(F.col("count") <= CROWD, F.col("key")))
    sets = left.groupBy("node", "n", "part").agg(F.max("count").alias("count"), met.alias("met"))
    texts = texts_of(sets.select("node"), rows, docs)
    sharp = texts.mapInArrow(batches(make, _SHARPER, 1000), "node long, keys array<long>, sketch array<long>").dropDuplicates(["node"])
    sharp = stored(sharp.join(sets, "node"), "shingle-sharp")
    own = sharp.select("node", "n", "part", "sketch", F.col("met").alias("all"), F.array().cast("array<long>").alias("met"))
    few = left.filter(F.col("count") <= CROWD).select("key", "node").join(own, "node")
    many = sharp.filter(F.col("count") > CROWD).select("node", "n", "part", "sketch", F.col("keys").alias("all"), "met")
    shared = many.select("part", F.explode("all").alias("key")).groupBy("key").agg(F.count_distinct("part").alias("parts")).filter("parts > 1").select("key")
    keyed = stored(many.select("*", F.explode("all").alias("key")).join(shared, "key"), "shingle-keyed")
    return _compared(few).union(_compared(keyed)).distinct()


def close(rows: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints are equal or linked by ``near``.

    The least set of a fingerprint stands for it: it is paired with the others of the same one, and with those that
    stand for the linked ones.
    """
    sets = rows.filter("n > 0").select("print", "node").distinct()
    first = stored(sets.groupBy("print").agg(F.min("node").alias("first")), "shingle-prints")
    equal = sets.join(first, "print").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = near(first.select("print"))
    of = [first.select(F.col("print").alias(x), F.col("first").alias(f"first_{x}")) for x in "ab"]
    return equal.union(found.join(of[0], "a").join(of[1], "b").select(*_ordered("first_a", "first_b")))


def links(rows: DataFrame, docs: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links (a, b) between sets that connect all that share a band and reach the least similarity.

    ``near`` gives the links between SimHash fingerprints.  First the sets of linked fingerprints are compared, and all
    sets of a band with a few of them; what is connected by then needs no further comparison: a group of near copies is
    settled with a few pairs a set.  Of the bands with several parts left, the sets of different parts get a sketch, and
    those with like sketches are compared.  Beyond ``CROWD`` sets in a band, as in documents that share one frequent
    passage and little else, they must share a sharper key too.
    """
    keys = stored(rows.select(F.explode("keys").alias("key"), "node", "n").distinct(), "shingle-keys")
    crowds = keys.groupBy("key").count().filter("count > 1")
    bands = stored(keys.join(crowds, "key").select("key", "node", "n", "count"), "shingle-bands")
    pivots = bands.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("_")).agg(F.min(F.struct(F.col("node").alias("other"), F.col("n").alias("m"))).alias("p")).select("key", "p.*")
    stars = bands.join(pivots, "key").filter((F.col("node") != F.col("other")) & _fits("n", "m")).select(*_ordered("node", "other"))
    first = stored(close(rows, near).union(stars).distinct(), "shingle-pairs")
    found = stored(verified(first, rows, docs), "shingle-links")
    parts = components(found, "shingle-first")
    placed = stored(bands.join(parts, "node", "left").select("key", "node", "n", "count", F.coalesce("component", "node").alias("part")), "shingle-placed")
    split = placed.groupBy("key").agg(F.count_distinct("part").alias("parts")).filter("parts > 1").select("key")
    left = stored(placed.join(split, "key"), "shingle-left")
    if left.isEmpty():
        return found
    second = stored(across(left, rows, docs).join(first, ["a", "b"], "left_anti"), "shingle-pairs")
    return found.union(verified(second, rows, docs))


def near_duplicates(docs: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, digest, component) of each row of docs (doc_id, text); ``near`` links SimHash fingerprints (print).

    Equal sets are one node, however many documents have them; texts without words have equal sets.
    """
    rows = stored(sketches(docs), "shingle-rows", TEXTS)
    parts = components(stored(links(rows, docs, near), "shingle-links"), "shingle")
    return rows.join(parts, "node", "left").select("doc_id", "digest", F.coalesce("component", "node").alias("component"))
