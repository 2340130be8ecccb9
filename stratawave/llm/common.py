"""Helpers of the corpus operators: stored tables, running sums, kept rows, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratawave.session import checkpoint_folder

from .tokens import release

#: White space of the contracts: `[\x20\x09-\x0D]`.
WORD = r"[^\x20\x09-\x0D]+"
#: Hash keys are spread over [0, KEYS).
KEYS = 1 << 32
#: Whole texts that a Python task gets at a time.
TEXTS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, batch: int = 0) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    This cuts the lineage: a later stage reads files, whichever executors are lost.
    Nondeterministic columns (row ids) are fixed from here on.  Meanwhile Python tasks get at most ``batch`` rows at a
    time, if given: an Arrow batch lies in the executor and in its Python worker, each beside the next one.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"
    usual = int(spark.conf.get(_BATCH))
    fewer = batch and not 0 < usual <= batch
    if fewer:
        spark.conf.set(_BATCH, batch)
    try:
        df.write.parquet(path)
    finally:
        if fewer:
            spark.conf.set(_BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def digest(text: Column) -> Column:
    """MD5 of a text (of the empty text for null), used to tell rows of one id apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(df: DataFrame, group: str, key: str, order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the same group that come earlier.

    Rows of a group are ordered by ``key`` (a uniform hash in [0, 2^32)), then by ``order``.  Equal ranges of
    the key are sorted on their own, so a hot group is spread over many tasks; only one total for each range meets
    in one task.  A range holds about max(1024, sqrt(n)) rows, so the totals of a group number sqrt(n) at most.
    ``df`` is read three times and should be stored; ``group`` and ``key`` are not null.
    """
    n = df.count()
    ranges = max(1, ceil(n / max(1024, isqrt(n))))
    df = df.withColumn("_range", F.floor(F.col(key).cast("double") * ranges / KEYS).cast("long"))
    earlier = (Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.sum(value).over(Window.partitionBy(group, "_range").orderBy(key, *order).rowsBetween(*earlier)))
    totals = df.groupBy(group, "_range").agg(F.sum(value).alias("_total"))
    bases = totals.select(group, "_range", F.sum("_total").over(Window.partitionBy(group).orderBy("_range").rowsBetween(*earlier)).alias("_base"))
    out = local.join(bases, [group, "_range"])
    return out.withColumn(name, F.coalesce("_local", F.lit(0)) + F.coalesce("_base", F.lit(0))).drop("_local", "_base", "_range")


def numbered(df: DataFrame, group: str, order: list[Column], name: str, label: str) -> DataFrame:
    """``df``, stored, with ``name``: the place (from 0) of a row among its group's rows in this order.

    All rows are sorted by ranges of (group, order), so a hot group lies in many tasks.  What meets in one task are
    the row counts of a group, one for each range that it lies in.  ``group`` is not null; fully equal rows follow each other.
    """
    rows = df.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    rows = stored(rows.withColumn("_at", F.monotonically_increasing_id()), label).withColumn("_range", F.shiftright("_at", 33))
    starts = rows.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(group, "_range", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(starts, [group, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def keep_rows(docs: DataFrame, kept: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``docs`` named by ``kept`` (doc_id, digest, ``by``, copies), each ``copies`` times, with all their columns.

    A name stands once in ``kept``.  Of rows of ``docs`` with one name the one with the least hash of its other columns is
    taken.  Extra columns of ``docs`` may have any names.
    """
    names = [f"k{i}" for i in range(len(by) + 2)]
    own = [F.col("doc_id"), digest(F.col("text")), *(F.col(c) for c in by)]
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(n) for c, n in zip(own, names, strict=True)))
    if not rows.groupBy(*names).count().filter("count > 1").isEmpty():
        others = [F.col("row")[c] for c in docs.columns if c != "text"]
        rows = rows.groupBy(*names).agg(F.min_by("row", F.xxhash64(F.to_json(F.struct(*others)))).alias("row"))
    given = kept.select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(("doc_id", "digest", *by))), F.col("copies").cast("int").alias("copies"))
    same = [F.col(n).eqNullSafe(F.col(f"g{i}")) for i, n in enumerate(names)]
    joined = rows.join(given, reduce(Column.__and__, same)).filter("copies > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_")).select("row.*")


def ends(edges: DataFrame) -> DataFrame:
    """The distinct nodes of ``edges`` (a, b); each side is combined where it lies, so no edge becomes two rows."""
    return edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (a, b).

    Alternates two steps: every node hands its larger neighbours, then its smaller ones, to the smallest node it knows.
    An edge is one row (high, low), so a node's least neighbour is a minimum of its own rows.  Each step is one grouped
    minimum and one join, and is stored; paths halve, so the rounds grow with the logarithm of the longest path.  It ends
    when no node that others point to points on, and each points to one.  A node with very many neighbours is a skewed
    join, which adaptive execution splits; no neighbour list is gathered.
    """
    def least(pairs: DataFrame, of: str) -> DataFrame:
        return pairs.groupBy(F.col("high").alias(of)).agg(F.min("low").alias("least"))

    highs = [F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")]
    pairs = stored(edges.filter("a <> b").select(*highs).distinct(), f"{label}-edges")
    while True:
        to = F.coalesce("least", "low")
        large = stored(pairs.join(least(pairs, "low"), "low", "left").select("high", to.alias("low"), F.col("least").isNotNull().alias("moved")), f"{label}-large")
        if large.filter("moved").isEmpty() and large.groupBy("high").count().filter("count > 1").isEmpty():
            break
        own = least(large, "high")
        small = large.select("high", "low").join(own, "high").filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        pairs = stored(small.union(own).distinct(), f"{label}-edges")
    named = pairs.select(F.col("high").alias("node"), F.col("low").alias("least"))
    return ends(edges).join(named, "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def remainder(column: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def crc32_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text: one step for each bit, the byte enters with its first."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), {step}), 4294967295)"


def summed(rows: DataFrame, matrix: Callable[[pa.RecordBatch], np.ndarray], groups: int = 256) -> np.ndarray:
    """Sum over all rows of the matrix (of fixed shape) that ``matrix`` gives for a batch.

    Each task adds its own part.  Parts are added within ``groups`` groups of tasks, then across the groups; both read
    their parts as a stream in order, so a task holds two matrices and only the sum goes to the driver.  Without rows the
    result is empty.
    """
    schema = pa.schema([("of", pa.int32()), ("width", pa.int32()), ("sum", pa.binary())])
    ddl = "of int, width int, sum binary"

    def part(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in source:
            if batch.num_rows:
                m = matrix(batch)
                total = m if total is None else total + m
            del batch
            release()
        if total is not None:
            yield pa.record_batch([[0], [total.shape[1]], [total.astype("<f8").tobytes()]], schema=schema)

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, width, total = None, 0, None
        for batch in source:
            for i in range(batch.num_rows):
                of, m = batch.column(0)[i].as_py(), np.frombuffer(batch.column(2)[i].as_py(), "<f8")
                if of != current and current is not None:
                    yield pa.record_batch([[current], [width], [total.tobytes()]], schema=schema)
                total = m if of != current else total + m
                current, width = of, batch.column(1)[i].as_py()
        if current is not None:
            yield pa.record_batch([[current], [width], [total.tobytes()]], schema=schema)

    parts = rows.mapInArrow(part, ddl).select((F.spark_partition_id() % groups).alias("of"), "width", "sum", F.spark_partition_id().alias("task"))
    some = parts.repartition("of").sortWithinPartitions("of", "task").select("of", "width", "sum").mapInArrow(add, ddl)
    whole = some.repartition(1).sortWithinPartitions("of").select(F.lit(0).alias("of"), "width", "sum").mapInArrow(add, ddl).first()
    return np.frombuffer(whole["sum"], "<f8").reshape(-1, whole["width"]).copy() if whole else np.zeros(0)
