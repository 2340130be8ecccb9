"""Quality classifier: kernel ridge on document statistics by random Fourier features, then isotonic calibration."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stored, summed, table
from .tokens import batches

#: Random features, ridge penalty (for each training row), bins of the calibration.
FEATURES, PENALTY, BINS = 256, 1e-3, 1024

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SPACE = b" \t\n\r\x0b\x0c"
_HIGH = bytes(range(128, 256))
_STOPS = b".,;:?'\"()-"
_MARKS = bytes(set(range(33, 127)) - set(_UPPER + _LOWER + _DIGIT + _STOPS))

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "word_bytes", "upper", "lower", "digit", "space", "high", "stops", "marks", "control",
    "distinct_words", "top_word", "top5_words", "repeated_next", "distinct_lines", "line_words", "marked_words", "marked_ends",
    "stopped_words", "capital_words", "all_upper_words", "digit_words", "long_words", "short_words", "single_marks", "packed", "stopped_lines", "word_spread",
)
_ROWS = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])


def statistics(text: str | None) -> list[float]:
    """Numbers of one whole text; all 0 for null and empty texts."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    if not n:
        return [0.0] * len(STATISTICS)
    share = [(n - len(data.translate(None, c))) / n for c in (_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOPS, _MARKS)]
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    w, m = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    top = counts.most_common(5)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    first, last = bytes(x[0] for x in words), bytes(x[-1] for x in words)
    marked = sum(k for x, k in counts.items() if x.translate(None, _MARKS) != x)
    digits = sum(k for x, k in counts.items() if x.translate(None, _DIGIT) != x)
    single = sum(k for x, k in counts.items() if len(x) == 1 and x in _MARKS)
    shout = sum(k for x, k in counts.items() if len(x) > 1 and x.isupper())
    cut = lambda s, c: len(s) - len(s.translate(None, c))
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), lengths.mean(), *share, max(0.0, 1 - sum(share)),
        len(counts) / w, (top[0][1] if top else 0) / w, sum(k for _, k in top) / w,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, len(set(lines)) / m, np.log1p(w / m), marked / w, cut(last, _MARKS) / w,
        cut(last, _STOPS) / w, cut(first, _UPPER) / w, shout / w, digits / w, float((lengths > 20).mean()), float((lengths <= 2).mean()), single / w,
        len(zlib.compress(data, 1)) / n, sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, lengths.std(),
    ]


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of each row of docs (doc_id, text): the statistics of its text."""
    def make(batch: pa.RecordBatch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield [doc_id, statistics(text)]

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(batches(make, _ROWS, 5_000), "doc_id long, x array<float>")


class Kernel:
    """Random Fourier features of a Gaussian kernel over scaled statistics, and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.directions = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        z = np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def isotonic(score: np.ndarray, hits: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing hit rates by pooling adjacent violators; (score, rate) of each pool, rates a little inside 0 and 1."""
    pools: list[list[float]] = []
    for s, h, n in zip(score, hits, rows, strict=True):
        pools.append([s * n, h, n])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], (p[:, 1] + 0.1) / (p[:, 2] + 0.2)


def scores(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, features: int = FEATURES, penalty: float = PENALTY, seed: int = 1) -> DataFrame:
    """(doc_id, held_out, score) of each row of docs (doc_id, text); labels has (doc_id, quality).

    * Learns from all labelled rows whose crc32(doc_id as text) mod ``folds`` is not ``held``: a fifth of them calibrate, the
      others fit.  Null ids are not held out and have no label; of repeated labels of an id the largest counts.
    * The normal equations are sums over rows: every task adds its own and one matrix remains.
    * Null and empty texts have statistics 0 and a score like any other.  Without labels of both kinds the score is the
      share of label 1 (0.5 if there is no label).  An empty table gives no rows.
    """
    rows = stored(described(docs), "quality-statistics")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality").cast("double")).alias("y"))
    known = known.filter(remainder(F.col("doc_id"), folds) != held).withColumn("calibrates", remainder(F.concat(F.col("doc_id").cast("string"), F.lit("c")), 5) == 0)
    train = stored(rows.join(known, "doc_id").select("x", "y", "calibrates"), "quality-train")
    n, hits = train.agg(F.count("y"), F.sum("y")).first()
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out")
    if not n or hits in (0, n):
        return rows.select("doc_id", held_out, F.lit(float(hits / n) if n else 0.5).alias("score"))
    fit, held_back = train.filter("NOT calibrates"), train.filter("calibrates")
    if not fit.limit(1).count() or not held_back.limit(1).count():
        fit = held_back = train

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.stack([np.full(x.shape[1], len(x)), x.sum(0), (x ** 2).sum(0)])

    count, total, squares = summed(fit.select("x"), moments)
    mean = total / count
    kernel = Kernel(mean, np.sqrt(np.maximum(0, squares / count - mean ** 2)), features, seed)

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z, y = kernel(_matrix(batch.column(0))), batch.column(1).to_numpy()
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    sums = summed(fit.select("x", "y"), products)
    gram, right = sums[:, :-1], sums[:, -1]
    weights = np.linalg.solve(gram + penalty * float(count[0]) * np.diag([*[1.0] * features, 0.0]) / features, right)

    def raw(batch: pa.RecordBatch) -> np.ndarray:
        return kernel(_matrix(batch.column(0))) @ weights

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        at = np.clip(((raw(batch) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        y = batch.column(1).to_numpy()
        return np.stack([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)]).astype(float)

    ones, all_ = summed(held_back.select("x", "y"), binned)
    used = np.flatnonzero(all_)
    at, rate = isotonic((used + 0.5) / BINS * 2 - 0.5, ones[used], all_[used])

    def score(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            s = raw(pa.record_batch([batch.column(1)], names=["x"])) if batch.num_rows else np.zeros(0)
            # A trace of the ridge score keeps the order within a pool.
            p = 0.999 * np.interp(s, at, rate) + 0.001 * np.clip((s + 0.5) / 2, 0, 1)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(p)], names=["doc_id", "held_out", "score"])

    return rows.select("doc_id", "x", held_out).mapInArrow(score, "doc_id long, held_out boolean, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
