"""Wide and long shapes, grids and lag rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.sources.readers import numeric_columns


def to_long(df: DataFrame, ids: Sequence[str] = ("date",), name: str = "series", value: str = "price",
            drop_null: bool = True) -> DataFrame:
    """Numeric columns to rows; columns that are not numeric are ignored."""
    columns = numeric_columns(df, skip=ids)
    typed = df.select(*ids, *[F.col(c).cast("double") for c in columns])
    out = typed.unpivot(list(ids), columns, name, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def long_summary(df: DataFrame, series: str = "series", date: str = "date") -> DataFrame:
    return df.agg(
        F.count_distinct(series).alias("n_series"), F.count("*").alias("n_obs"),
        F.min(date).alias("date_start"), F.max(date).alias("date_end"),
    )


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Sequence[str]) -> DataFrame:
    """One column per name.  The names are passed, so no job looks them up."""
    return df.groupBy(*keys).pivot(name, list(columns)).agg(F.first(value, ignorenulls=True))


def complete_grid(tidy: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Every scenario x regime x variable x t x baseline flag, values joined where they exist.

    Scenarios stay rows.  The other axes are the model's own sets (its regimes, its
    variables, its horizon), bounded by the model.  With an ``uncertainty`` column every
    index is a model of its own and part of the key.
    """
    index = ["uncertainty"] if "uncertainty" in tidy.columns else []
    axes = tidy.groupBy(*index).agg(F.struct(
        F.array_sort(F.collect_set("regime")).alias("regimes"),
        F.array_sort(F.collect_set("variable")).alias("variables"),
        F.sequence(F.min("t"), F.max("t")).alias("steps"),
    ).alias("_axes"))
    scenarios = tidy.select(*index, "scenario").distinct()
    with_axes = scenarios.join(axes, index) if index else scenarios.withColumn("_axes", axes.scalar())
    grid = (
        with_axes
        .withColumn("regime", F.explode("_axes.regimes"))
        .withColumn("variable", F.explode("_axes.variables"))
        .withColumn("t", F.explode("_axes.steps"))
        .withColumn("is_baseline", F.explode(F.array(F.lit(True), F.lit(False))))
        .drop("_axes")
    )
    keys = [*index, "scenario", "regime", "variable", "t", "is_baseline"]
    return grid.join(tidy.select(*keys, "value", *extra), keys, "left")


def add_lags(df: DataFrame, lags: int, keys: Sequence[str] = ("series",), order: str = "date",
             value: str = "ret") -> DataFrame:
    """Columns ``lag_1..lag_p``; rows without all ``p`` predecessors are left out.

    The window holds one series: at most one row per calendar step.
    """
    over = W.partitionBy(*keys).orderBy(order)
    cols = {f"lag_{k}": F.lag(value, k).over(over) for k in range(1, lags + 1)}
    return df.withColumns({**cols, "_pos": F.row_number().over(over)}).where(F.col("_pos") > lags).drop("_pos")
