"""Sinks: Parquet tables, run rows, upserts and manifests.

Spark's commit protocol writes to a temporary place and renames on success, so
no write here needs its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.sources.digests import PART, is_long, long_digests, resumable


def save(df: DataFrame, path: str, overwrite: bool = True, partition_by: Sequence[str] = (),
         fmt: str = "parquet") -> None:
    writer = df.write.format(fmt).mode("overwrite" if overwrite else "errorifexists")
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def save_by_index(df: DataFrame, path: str, column: str = "index", overwrite: bool = True) -> None:
    """One folder per index.  Rows are first spread by (index, month), not by index
    alone, so one large index does not end in one writing task."""
    spread = df.repartition(F.col(column), F.trunc("date", "year")) if "date" in df.columns else df
    save(spread, path, overwrite, partition_by=[column])


def panel_summary(df: DataFrame, series: str = "series", date: str = "date", value: str = "price") -> DataFrame:
    """Metadata row of a panel: rows, series, span, missing share."""
    return df.agg(
        F.count("*").alias("n_obs"),
        F.count_distinct(series).alias("n_series"),
        F.min(date).alias("date_start"),
        F.max(date).alias("date_end"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.round(100.0 * F.avg(F.col(value).isNull().cast("double")), 2).alias("pct_missing"),
    )


def run_row(summary: DataFrame, stage: str, run_at: Column | None = None, note: str = "") -> DataFrame:
    """A summary row with the stage and time stamp of its run."""
    stamp = run_at if run_at is not None else F.current_timestamp()
    return summary.select(F.lit(stage).alias("stage"), stamp.alias("run_at"), F.lit(note).alias("note"), "*")


def append_run(row: DataFrame, path: str) -> None:
    row.write.mode("append").option("mergeSchema", True).parquet(path)


def error_row(spark: SparkSession, index: str, series: str, stage: str, message: str) -> DataFrame:
    return spark.createDataFrame(
        [(index, series, stage, message)], "index string, series string, stage string, message string"
    ).withColumn("run_at", F.current_timestamp())


def series_lists(df: DataFrame, kept: DataFrame, series: str = "series", date: str = "date",
                 value: str = "price") -> DataFrame:
    """Retained and dropped series with span and missing share."""
    stats = df.groupBy(series).agg(
        F.count(value).alias("n_obs"),
        F.min(date).alias("date_start"),
        F.max(date).alias("date_end"),
        F.round(100.0 * F.avg(F.col(value).isNull().cast("double")), 2).alias("pct_missing"),
    )
    marked = kept.select(series).distinct().withColumn("_kept", F.lit(True))
    return stats.join(marked, series, "left").select(
        series, F.when(F.col("_kept"), "retained").otherwise("dropped").alias("status"),
        "n_obs", "date_start", "date_end", "pct_missing",
    )


def latest(df: DataFrame, keys: Sequence[str], stamp: str, ties: Sequence[str] = ()) -> DataFrame:
    """Newest row per key.  ``max_by`` combines on the map side, so a key with very
    many versions is never sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(stamp), *[F.col(c) for c in ties])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return best.select(*keys, "_row.*")


def latest_by_file(spark: SparkSession, path: str, keys: Sequence[str], fmt: str = "parquet", ties: Sequence[str] = ()) -> DataFrame:
    """Row of each key from the file written last, over all versions stored below ``path``.

    The time is the file's own, which the scan gives as hidden metadata; files of one time are
    ordered by their paths, rows of one file by ``ties``.
    """
    rows = spark.read.format(fmt).option("recursiveFileLookup", True).load(path)
    stamped = rows.select("*", F.col("_metadata.file_modification_time").alias("_at"), F.col("_metadata.file_path").alias("_file"))
    return latest(stamped, keys, "_at", ["_file", *ties]).drop("_at", "_file")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new`` replaces the rows of ``old`` that have the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def file_manifest(spark: SparkSession, path: str, pattern: str = "*", part: int = PART) -> DataFrame:
    """File, bytes and sha256 of every file below ``path``.

    A file of up to ``part`` bytes is hashed whole by one task, a longer one in steps (see ``digests``).  Files with the
    ending of a compression codec, and all where Python's OpenSSL cannot hand its state on, are hashed whole: there
    a file must fit the binary source's 2 GB limit; larger ones fail instead of being cut.
    """
    def read(fmt: str, **options: str) -> DataFrame:
        return spark.read.format(fmt).options(**options).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)

    columns = "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")
    files = read("binaryFile")
    found = long_digests(spark, read, part) if resumable() else None
    files = files.select(*columns) if found is None else files.where(~is_long(part)).select(*columns).unionByName(found)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "bytes", "sha256")


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Order-insensitive content hash of a table: row count and summed row hashes.

    The sum is a wide decimal, so it cannot overflow; partial sums combine on the map side.
    """
    cols = list(columns or df.columns)
    row = F.xxhash64(*cols).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(row).alias("row_hash_sum")).select(
        "n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("row_hash_sum").cast("string")), 256).alias("content_hash")
    )
