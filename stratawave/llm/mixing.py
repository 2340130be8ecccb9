"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the documents are sorted by key range by range, distributed
prefix sums of the word counts place each document on its source's line, and the mix is the first ``target`` words of
that line, which starts anew (a further epoch) where the target is longer than the source.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digest, keep_rows, running, stored, table, word_count

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size, weight) with the words that the mix wants of each source.

    The sources share ``share`` times all words by weight.  A target stops at ``most`` times its source's size and the
    excess goes to the others by weight.  Sources fill up in order of size / weight: with the first k full, the rest
    get ``level`` words for each unit of weight, and the first k for which nobody else is above its limit is the answer.
    """
    everyone = Window.partitionBy()
    order = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    limit = F.col("source_size") * F.lit(float(most))
    filled = F.coalesce(F.sum(limit).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights = F.sum(F.col("weight").cast("double")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everyone) * F.lit(float(share)) - filled) / weights
    steps = sizes.withColumn("_level", level).withColumn("_fits", F.col("_level") * F.col("weight") <= limit)
    found = F.first(F.when(F.col("_fits"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return steps.withColumn("target", F.coalesce(F.least(limit, found * F.col("weight")), limit)).drop("_level", "_fits")


def cycling(sources: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights in turn for the sources by code point, null last, and a rank for each source.

    One row for each source meets in one task: the sources of a mix are a list that people keep.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int"))
    return sources.withColumn("source_rank", rank).withColumn("weight", weight)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1, size: Column | None = None) -> DataFrame:
    """What a mix takes of each document (doc_id, text, source): taken words, whole copies, and its source's target.

    * size: words of the text; null and empty texts have none, take part and give nothing.
    * Null is a source of its own, the last one.  Null and repeated ids are told apart by their texts; fully equal rows
      are interchangeable and follow each other.
    * ``taken`` adds up to the rounded target exactly: the document on the cut gives the words before it.
      ``copies`` is for users of whole documents: the document on the cut counts if half of it lies before the cut.
    * The result depends on ids, texts and seed only, not on partitions.  An empty table gives no rows.
    """
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest(F.col("text"))))
    slim = stored(docs.select(
        "doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), digest(F.col("text")).alias("digest"), key.alias("place"),
    ), "mix")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(cycling(sizes, weights), share, most).withColumnRenamed("source", "_source")
    lined = stored(
        slim.join(plan, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
        .withColumn("key", F.conv(F.substring("place", 1, 8), 16, 10).cast("long")), "mix-lines")
    lined = running(lined, "source_rank", "key", ["place", "size"], F.col("size"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return lined.select(
        "doc_id", "digest", "source", "size", "source_size", F.col("target"),
        (epochs * F.col("size") + part).cast("long").alias("taken"),
        (epochs + F.when((rest > 0) & (part * 2 >= F.col("size")), 1).otherwise(0)).cast("int").alias("copies"),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole and as often as it takes them.

    Rows of one id and text count for their own sources.
    """
    parts = mix(docs)
    kept = parts.groupBy("doc_id", "digest", "source").agg(F.sum("copies").alias("copies")).filter("copies > 0")
    return keep_rows(docs, kept, ("source",))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('1|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
      - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight::DOUBLE) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
f AS (
  SELECT arg_min(level, source_size / weight) AS level FROM l WHERE level * weight <= source_size * 2.0::DOUBLE),
t AS (
  SELECT source, source_size, coalesce(least(source_size * 2.0::DOUBLE, (SELECT level FROM f) * weight), source_size * 2.0::DOUBLE) AS target FROM s),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM r)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e
"""
