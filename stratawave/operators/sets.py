"""Set operations and ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def common_names(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def names_only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).distinct().join(b.select(column).distinct(), column, "left_anti")


def level_order(column: str, levels: Sequence[str]) -> Column:
    """Sort key of an ordered category; unknown levels come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))
    return F.when(at > 0, at).otherwise(F.lit(len(levels) + 1))


def top_n(df: DataFrame, keys: Sequence[str], by: Column, n: int, ties: Sequence[str] = (),
          with_ties: bool = False) -> DataFrame:
    """Largest ``n`` rows per group, with or without the rows that tie with the last.

    Spark turns ``rank <= n`` into a per-partition limit before the shuffle, so a
    large group sends only its candidates.
    """
    order = [by.desc(), *[F.col(c).asc() for c in ties]]
    over = W.partitionBy(*keys).orderBy(by.desc() if with_ties else order[0], *([] if with_ties else order[1:]))
    rank = F.rank().over(over) if with_ties else F.row_number().over(over)
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def head(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)
