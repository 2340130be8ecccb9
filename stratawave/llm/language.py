"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights are trained with follow-the-regularised-leader (per-coordinate steps, elastic-net penalty); a temperature then
calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, stored, summed, table
from .tokens import batches, forget, release

#: n-grams of 1 to 3 characters fall into 2^BITS buckets.
BITS, GRAMS = 15, 3
SIZE = 1 << BITS
#: At most about so many labelled documents fit the weights, spread evenly over the languages.
MOST_TRAINING = 16_000
#: Parallel learners, passes, and the learner's step and penalties.
LEARNERS, PASSES, ALPHA, BETA, L1, L2 = 8, 3, 0.5, 1.0, 0.02, 0.02
UNKNOWN = "und"
#: Documents that the stage rejects have no letter or a lower score.
LEAST_SCORE = 0.3

_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SAMPLE = pa.schema([("y", pa.int32()), ("calibrates", pa.bool_()), ("grams", pa.binary())])
_STEP = pa.schema([("learner", pa.int32()), ("z", pa.binary()), ("squares", pa.binary())])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of the n-grams of the whole text in lower case."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total = np.zeros(SIZE, np.int64)
    step = 1 << 18
    for start in range(0, len(codes), step):
        part = codes[start:start + step + GRAMS - 1]
        n_starts = min(step, len(codes) - start)
        h = np.zeros(len(part), np.uint64)
        for k in range(GRAMS):
            if len(part) <= k:
                break
            h = h[:len(part) - k] * np.uint64(_MULTIPLIERS[0]) + (part[k:] + np.uint64(k + 1)) * np.uint64(_MULTIPLIERS[1])
            key = (h[:n_starts] * np.uint64(_MULTIPLIERS[2])) >> np.uint64(64 - BITS)
            total += np.bincount(key.astype(np.int64), minlength=SIZE)
    at = np.flatnonzero(total)
    return at, total[at]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _row(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf[at]
    size = np.sqrt((x ** 2).sum())
    return x / size if size else x


def _grams(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of a stored row."""
    pair = np.frombuffer(data, "<i4").reshape(2, -1)
    return pair[0], pair[1]


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The regularised leader: coordinates whose sum stays within the first penalty are zero."""
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) > L1, w, 0.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Languages, inverse document frequencies, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float) -> None:
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, n = counts(text)
        p = _softmax(_row(at, n, self.idf) @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(docs: DataFrame, folds: int = 5, held: int = 0, most: int = MOST_TRAINING) -> Model:
    """Learn from docs (doc_id, text, lang) with a language, whose crc32(doc_id as text) mod ``folds`` is not ``held``.

    Languages and document frequencies cover all of these rows.  The weights are fitted on about ``most`` of them at most,
    chosen by a hash of the id with the same number for each language; a fifth of those set the temperature instead.
    Equal rows are one row that counts 1 + ln(copies) times.  Each learner reads its own rows as a stream in the order of a
    hash; what the learners add to the leader's sums is added up after each pass.  Rows without id, language or letters do not teach.  Without any teaching row the model knows no language.
    """
    known = docs.filter(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), folds) != held)).select("doc_id", "text", "lang")
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}
    languages = list(rows)
    if not languages:
        return Model([], np.ones(SIZE), np.zeros((SIZE, 0)), 1.0)

    def frequencies(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((1, SIZE + 1))
        for text in batch.column(0).to_pylist():
            if text:
                total[0, counts(text)[0]] += 1
                total[0, SIZE] += 1
        return total

    found = summed(known.select("text"), frequencies)[0]
    idf = np.log((1 + found[SIZE]) / (1 + found[:SIZE])) + 1
    share = {x: min(1.0, most / len(languages) / n) for x, n in rows.items()}

    def sample(batch: pa.RecordBatch):
        for text, lang, calibrates in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if has_letter(text):
                at, n = counts(text)
                yield [languages.index(lang), calibrates, np.stack([at, n]).astype("<i4").tobytes()]

    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 11) / float(1 << 53)
    wanted = F.element_at(F.create_map(*[F.lit(v) for x in share.items() for v in x]), F.col("lang"))
    chosen = known.filter(place < wanted).select("text", "lang", (F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(5)) == 0).alias("calibrates"))
    teach = chosen.mapInArrow(batches(sample, _SAMPLE, 100), "y int, calibrates boolean, grams binary")
    teach = stored(teach.groupBy("y", "calibrates", "grams").agg(F.count(F.lit(1)).alias("copies")), "language-sample")
    place = F.xxhash64("grams", "y")
    fit = teach.filter("NOT calibrates").select(F.pmod(place, F.lit(LEARNERS)).cast("int").alias("learner"), place.alias("place"), "y", "grams", "copies")
    fit = fit.repartitionById(LEARNERS, "learner").sortWithinPartitions("place", "grams", "y").select("learner", "y", "grams", "copies")
    z, squares = np.zeros((SIZE, len(languages))), np.zeros((SIZE, len(languages)))

    def learn(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        own_z, own_n, learner = z.copy(), squares.copy(), None
        for batch in source:
            for i in range(batch.num_rows):
                learner, y, grams, copies = (c[i].as_py() for c in batch.columns)
                at, n = _grams(grams)
                x = _row(at, n, idf)
                w = _weights(own_z[at], own_n[at])
                error = _softmax(x @ w)
                error[y] -= 1
                g = x[:, None] * error * (1 + np.log(copies))
                step = (np.sqrt(own_n[at] + g ** 2) - np.sqrt(own_n[at])) / ALPHA
                own_z[at] += g - step * w
                own_n[at] += g ** 2
        if learner is not None:
            yield pa.record_batch([[learner], [(own_z - z).tobytes()], [(own_n - squares).tobytes()]], schema=_STEP)

    for _ in range(PASSES):
        for r in fit.mapInArrow(learn, "learner int, z binary, squares binary").orderBy("learner").toLocalIterator():
            z = z + np.frombuffer(r["z"]).reshape(z.shape)
            squares = squares + np.frombuffer(r["squares"]).reshape(z.shape)
    weights = _weights(z, squares)
    tried = np.exp(np.linspace(np.log(0.02), np.log(5), 60))

    def losses(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros((1, len(tried)))
        for i in range(batch.num_rows):
            y, grams, copies = (c[i].as_py() for c in batch.columns)
            at, n = _grams(grams)
            p = _softmax(_row(at, n, idf) @ weights[at] / tried[:, None])
            total[0] -= copies * np.log(np.maximum(p[:, y], 1e-300))
        return total

    loss = summed(teach.filter("calibrates").select("y", "grams", "copies"), losses)
    return Model(languages, idf, weights, float(tried[loss[0].argmin()]) if len(loss) else 1.0)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` in ``row``, with lang_pred and score; texts are read whole.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything if the model knows no language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches_: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        own = shared.value
        for texts in batches_:
            yield pd.DataFrame([own(t) for t in texts], columns=["lang_pred", "score"])
            del texts
            release()

    found = docs.select(F.struct("*").alias("row"), predict(F.col("text")).alias("found"))
    return found.select("row", "found.lang_pred", "found.score")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), train(docs)).select("row.doc_id", "lang_pred", "score").select("doc_id", held_out, "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows: with a letter, and a score of LEAST_SCORE or more."""
    found = identify(docs, train(docs))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")
