"""SimHash near-dedup with Golay-code fuzzy keys.

Fingerprints of 64 bits link at two or fewer differing bits.  A fingerprint is three segments.  Two errors over three
segments leave one segment free of errors, and the next one has two at most.  The Golay code makes that fuzzy segment an
equality: of all words within one bit of a segment, the decoder gives the index of the nearest codeword, one index or
six.  Two segments within two bits have a word in between that is within one bit of both, so they share an index.
Key: (which segment is exact, its bits, an index of the next one).  Equal keys are joined and the distance is verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import components, keep_rows, stored, table
from .shingles import signed
from .tokens import batches, release, worker_state

SEED, WORDS, NEAR = 42, 3, 2
#: Bits of the three segments; each is at most 23, the length of the code.
SEGMENTS = (22, 21, 21)
#: Generator polynomial of the binary Golay code of length 23 and dimension 12.
GENERATOR = 0b101011100011
#: Keys with more fingerprints than this are joined by their neighbours within one bit instead of pair by pair.
CROWD = 64

_ROWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.string()), ("print", pa.int64())])


def fingerprint(text: str | None) -> int:
    """Bits that are set in over half of the hashes of the word shingles; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) <= WORDS:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-WORDS] + 1])
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[WORDS - 1:].tolist(), strict=True)], "<u8")
    return shingles.majority(hashes)


def decoder() -> np.ndarray:
    """The table of ``golay_table``, one in each Python worker."""
    own = worker_state()
    if "golay" not in own:
        own["golay"] = golay_table()
    return own["golay"]


def golay_table() -> np.ndarray:
    """Index (the 12 message bits) of the nearest codeword for each of the 2^23 words.

    The code is perfect: the 2048 error patterns of up to three bits have different remainders by the generator.
    """
    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= np.where((x >> bit) & 1 == 1, GENERATOR << (bit - 11), 0)
        return x

    bits = 1 << np.arange(23)
    errors = [0, *bits]
    errors += [bits[i] | bits[j] for i in range(23) for j in range(i)]
    errors += [bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array(errors, np.int64)
    of = np.zeros(2048, np.int64)
    of[remainder(errors)] = errors
    index = np.empty(1 << 23, np.int16)
    for start in range(0, 1 << 23, 1 << 17):
        words = np.arange(start, start + (1 << 17), dtype=np.int64)
        index[words] = (words ^ of[remainder(words)]) >> 11
    return index


def indices(segment: np.ndarray) -> np.ndarray:
    """The 24 indices (with repeats) of the words within one bit of each segment."""
    near = segment[:, None] ^ np.concatenate([[0], 1 << np.arange(23)])[None, :]
    return decoder()[near]


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``prints``, key) of all distinct keys."""
    x = prints.astype(np.int64).view(np.uint64)
    parts, shift = [], 0
    for bits in SEGMENTS:
        parts.append(((x >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64))
        shift += bits
    where, keys = [], []
    for i in range(3):
        index = np.sort(indices(parts[(i + 1) % 3]), axis=1).astype(np.int64)
        new = np.ones(index.shape, bool)
        new[:, 1:] = index[:, 1:] != index[:, :-1]
        at, column = np.nonzero(new)
        where.append(at)
        keys.append((np.int64(i) << 40) | (parts[i][at] << 12) | index[at, column])
    return np.concatenate(where), np.concatenate(keys)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, print) of each row of docs (doc_id, text), read once, whole texts."""
    import hashlib

    def make(batch: pa.RecordBatch):
        for row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield [row, doc_id, hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest(), signed(fingerprint(text))]

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(batches(make, _ROWS), "row long, doc_id long, digest string, print long")


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (print) that connect all at two or fewer differing bits.

    A key's fingerprints are compared pair by pair while they are few.  Beyond ``CROWD`` each of them is joined to the
    words within one bit of it instead: two fingerprints within two bits share such a word, and all that share a word are
    within two bits of each other, so each is linked to the least of them.  That is exact and linear in the crowd.
    """
    def keyed(source):
        for batch in source:
            x = batch.column(0).to_numpy()
            for i in range(0, len(x), 10_000):
                at, key = golay_keys(x[i:i + 10_000])
                yield pa.record_batch([pa.array(x[i:i + 10_000][at]), pa.array(key)], names=["print", "key"])
            release()

    keys = stored(prints.mapInArrow(keyed, "print long, key long"), "simhash-keys")
    crowds = stored(keys.groupBy("key").count().filter("count > 1"), "simhash-crowds")
    few = keys.join(crowds.filter(F.col("count") <= CROWD), "key").select("key", "print")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= NEAR
    pairs = few.withColumnRenamed("print", "a").join(few.withColumnRenamed("print", "b"), "key").filter((F.col("a") < F.col("b")) & near).select("a", "b")
    many = keys.join(crowds.filter(F.col("count") > CROWD), "key").select("print").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64)])
    words = many.select("print", F.explode(flips).alias("flip")).select("print", F.col("print").bitwiseXOR(F.col("flip")).alias("word"))
    least = words.groupBy("word").agg(F.min("print").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = words.join(least, "word").filter("print <> least").select(F.col("least").alias("a"), F.col("print").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(row, doc_id, digest, fingerprint, component_id) of each row of docs (doc_id, text).

    * Null, empty and blank texts have fingerprint zero and are linked like any other.
    * component_id: the least doc_id that can be reached over links, itself included; null only where all ids are null.
    * Copies share a fingerprint and are one node of the graph, however many.  An empty table gives no rows.
    """
    rows = stored(fingerprints(docs), "simhash-rows")
    prints = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "simhash-prints")
    found = stored(links(prints.select("print")), "simhash-links")
    parts = components(found, "simhash")
    named = prints.join(parts, prints["print"] == parts["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    named = stored(named, "simhash-parts")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "component").select("print", "component", "component_id")
    return rows.join(of, "print").select("row", "doc_id", "digest", "component", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies: five-word shingles, similarity 0.8 or more.

    The fingerprints of the five-word shingles are linked by their Golay keys as in op6, and linked sets are verified.
    The digest contract (three words, two bits) binds op6 only; at two bits nearly all pairs of similarity 0.8 are
    missed, so bands of minima find the others.
    """
    found = shingles.near_duplicates(docs, links)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("digest"))
    kept = found.groupBy("component").agg(F.min(first).alias("first"))
    return keep_rows(docs, kept.select("first.doc_id", "first.digest", F.lit(1).alias("copies")))
