"""Versioned tables of fitted models, keyed by model id.

A stage that fits models saves them under a version; later stages read the newest version of
each model, so they need not fit again and a model that was not fitted anew keeps its old rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


def save_models(fits: DataFrame, path: str, version: str) -> None:
    """Write the rows as one version; a version that exists already is replaced, the others stay.

    Versions sort as text (``v0001``, or a time stamp).  Spark's dynamic partition overwrite replaces the folder of
    this version only, when the whole job has succeeded.
    """
    if not version or "/" in version:
        raise ValueError("a version is a text without slashes")
    rows = fits.withColumn(VERSION, F.lit(version))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(VERSION).parquet(path)


def load_models(spark: SparkSession, path: str, fits: DataFrame | None = None, models: Sequence[str] | None = None,
                version: str | None = None) -> DataFrame:
    """All rows of the newest version of every model, or of the named models, up to ``version``.

    ``fits`` gives the schema where the caller knows it; without it that of the files is read.
    """
    reader = spark.read
    if fits is not None:
        reader = reader.schema(fits.schema.add(VERSION, "string") if VERSION not in fits.columns else fits.schema)
    rows = reader.parquet(path).withColumn(VERSION, F.col(VERSION).cast("string"))
    if models is not None:
        rows = rows.where(F.col("model").isin(*models))
    if version is not None:
        rows = rows.where(F.col(VERSION) <= version)
    newest = rows.groupBy("model").agg(F.max(VERSION).alias(VERSION))
    return rows.join(newest, ["model", VERSION])
