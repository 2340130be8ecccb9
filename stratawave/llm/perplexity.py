"""LM scoring by cross-entropy difference.

A target and a background model share one vocabulary, order and smoothing, and the background's counts are scaled to
the target's total, so that they differ by their texts only.  The vocabulary holds every word.  The most frequent words
are classes of their own, all others share one class: a token's loss is that of its class after the class before it,
plus, for the shared class, that of the word within it.  Class pairs are a table of bounded size; the words of the shared
class grow with the corpus and are counted and looked up by joins.  None of them is hot, as each is rarer than every
frequent word.  A document's score is the mean over its tokens of target loss minus background loss: low scores are
closer to the target.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .tokens import batches

#: Classes: all other words, document edge, and the most frequent words.  Class pairs number SIZE^2 at most.
SIZE = 4096
OTHER, EDGE = 0, 1
#: Weight of the single-word distribution against the counts of a context.
PRIOR = 50.0
#: A task passes its counts on when it holds so many words, to bound its memory.
FLUSH = 500_000

_WORDS = pa.schema([("word", pa.binary()), ("n", pa.int64())])


def words(text: str | None) -> list[bytes]:
    """Words of the whole text with A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def vocabulary(docs: DataFrame, size: int = SIZE) -> dict[bytes, int]:
    """The ``size`` - 2 most frequent words of all documents, ties by their bytes; counts cover every word."""
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], schema=_WORDS)

        for batch in source:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
                if len(held) >= FLUSH:
                    yield out()
                    held = Counter()
        if held:
            yield out()

    found = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "word").limit(size - 2).collect()
    return {bytes(r["word"]): i for i, r in enumerate(top, 2)}


def encoded(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, words, times) of each row of docs (doc_id, text): the classes of its words as unsigned 16-bit
    integers, and its distinct words of the shared class, named by their 64-bit hashes, with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def encode(batch: pa.RecordBatch):
        own = shared.value
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = words(text)
            times = Counter(w for w in found if w not in own)
            names = np.fromiter(map(xxhash.xxh64_intdigest, times), np.uint64, len(times)).view(np.int64)
            yield [doc_id, np.fromiter((own.get(w, OTHER) for w in found), "<u2", len(found)).tobytes(), names, list(times.values())]

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches(encode, schema, 2_000), "doc_id long, ids binary, words array<long>, times array<int>")


def pair_keys(ids: bytes, size: int) -> np.ndarray:
    """previous * size + next for each token of a document; the edge stands before and after it."""
    row = np.full(len(ids) // 2 + 2, EDGE, np.int64)
    row[1:-1] = np.frombuffer(ids, "<u2")
    return row[:-1] * size + row[1:]


def pair_counts(coded: DataFrame, size: int = SIZE) -> DataFrame:
    """(key, n) over all tokens of the encoded documents."""
    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.uint32)
        held, n = [], 0

        def add() -> None:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            total[keys] += times.astype(np.uint32)

        for batch in source:
            for ids in batch.column(0).to_pylist():
                held.append(pair_keys(ids, size))
                n += len(held[-1])
                if n > 2_000_000:
                    add()
                    held, n = [], 0
        if held:
            add()
        used = np.flatnonzero(total)
        for i in range(0, len(used), 100_000):
            part = used[i:i + 100_000]
            yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["key", "n"])

    return coded.select("ids").mapInArrow(count, "key int, n long").groupBy("key").agg(F.sum("n").alias("n"))


def losses(target: DataFrame, background: DataFrame, size: int = SIZE, prior: float = PRIOR) -> np.ndarray:
    """Target loss minus background loss for each class pair of the background, 0 for pairs that never occur.

    A pair's probability mixes its count with the single-class distribution (add-one over the classes), which weighs
    as much as ``prior`` tokens.  The result has size^2 numbers whatever the input.
    """
    pairs = stored(background.withColumnRenamed("n", "b").join(target.withColumnRenamed("n", "t"), "key", "left").na.fill(0, ["t"]), "lm-pairs")
    b_all, t_all = pairs.agg(F.sum("b"), F.sum("t")).first()
    scale = (t_all or 0) / b_all if b_all else 0.0
    single = {}
    for name, column in (("left", F.floor(F.col("key") / size)), ("right", F.col("key") % size)):
        b, t = np.zeros(size), np.zeros(size)
        for r in pairs.groupBy(column.cast("int").alias("w")).agg(F.sum("b").alias("b"), F.sum("t").alias("t")).collect():
            b[r["w"]], t[r["w"]] = r["b"] * scale, r["t"]
        single[name] = (b, t)
    out = np.zeros(size * size, np.float32)
    for key, b, t in _chunks(pairs):
        left, right = key // size, key % size
        loss = []
        for counts, (lefts, rights) in ((b * scale, (single["left"][0], single["right"][0])), (t, (single["left"][1], single["right"][1]))):
            alone = (rights[right] + 1) / (rights.sum() + size)
            loss.append(-np.log((counts + prior * alone) / (lefts[left] + prior)))
        out[key] = loss[1] - loss[0]
    return out


def _chunks(pairs: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs' counts on the driver: size^2 rows at most."""
    found = pairs.select("key", F.col("b").cast("float"), F.col("t").cast("float")).toArrow()
    for batch in found.to_batches(1_000_000):
        yield batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy().astype(float)


def word_gains(coded: DataFrame) -> DataFrame:
    """(row, gain): for each document, target loss minus background loss of its words within the shared class, summed.

    Both models add one to the counts of every word, and the background's counts are scaled to the target's total in
    the class, so that the denominators are equal and cancel.  Counts cover every word of every document.
    """
    each = coded.select("row", "wanted", F.inline(F.arrays_zip("words", "times"))).withColumnRenamed("words", "word")
    counts = stored(each.groupBy("word").agg(F.sum("times").alias("b"), F.sum(F.when(F.col("wanted"), F.col("times")).otherwise(0)).alias("t")), "lm-words")
    b_all, t_all = counts.agg(F.sum("b"), F.sum("t")).first()
    scale = (t_all or 0) / b_all if b_all else 0.0
    gains = counts.select("word", (F.log1p(F.col("b") * F.lit(scale)) - F.log1p("t")).alias("gain"))
    # The words grow with the corpus, so they are never broadcast.
    met = each.select("row", "word", "times").join(gains.hint("merge"), "word")
    return met.groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))


def scores(docs: DataFrame, target_ids: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_tokens, score) of each row of docs (doc_id, text); target_ids (doc_id) names the target documents.

    * Counts cover all documents and words, those of the target included in the background.
    * n_tokens: words and the closing edge, so an empty or null text has one token and a score.
    * Without target documents both models are the same but for the counts, and scores say nothing.  Repeated rows count as
      often as they occur.  Null ids are never in the target.  An empty table gives no rows.
    * ``size`` bounds the classes only, never the vocabulary.  Scores are rounded to nine digits, as sums over tasks
      have no fixed order.
    """
    # The target grows with the corpus, so it is never broadcast.
    wanted = target_ids.filter("doc_id IS NOT NULL").select("doc_id", F.lit(True).alias("wanted")).distinct().hint("merge")
    coded = encoded(docs, vocabulary(docs, size)).join(wanted, "doc_id", "left")
    coded = stored(coded.withColumn("wanted", F.coalesce("wanted", F.lit(False))).withColumn("row", F.monotonically_increasing_id()), "lm-coded")
    background, target = pair_counts(coded, size), pair_counts(coded.filter("wanted"), size)
    shared = docs.sparkSession.sparkContext.broadcast(losses(target, background, size))

    def score(batch: pa.RecordBatch):
        loss = shared.value
        for row, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            keys = pair_keys(ids, size)
            yield [row, doc_id, len(keys), float(loss[keys].sum(dtype=np.float64))]

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("total", pa.float64())])
    pairs = coded.select("row", "doc_id", "ids").mapInArrow(batches(score, schema), "row long, doc_id long, n_tokens long, total double")
    both = pairs.join(word_gains(coded).hint("merge"), "row", "left")
    total = F.col("total") + F.coalesce("gain", F.lit(0.0))
    return both.select("doc_id", "n_tokens", F.round(total / F.col("n_tokens"), 9).alias("score"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return scores(table(spark, sf_dir, "documents"), target)
