"""Bucketing, coverage and distribution statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.functions.quantiles import exact_quantiles


def bucket(df: DataFrame, keys: Sequence[str], stamp: str, value: str, how: str = "mean",
           anchor: str = "start", unit: str = "month") -> DataFrame:
    """Rows per calendar bucket and key to one value: mean, median, first or last.

    This is where raw rows become a panel.  Mean, first and last combine on the map
    side, so a key with a large part of the rows is not sent to one task; the median
    goes through :func:`exact_quantiles`, which splits it.
    """
    if unit == "month":
        when = scalars.month_anchor(F.col(stamp).cast("date"), anchor)
    else:
        when = F.date_trunc(unit, stamp).cast("date")
    rows = df.select(*keys, F.col(stamp).alias("_at"), when.alias("date"), F.col(value).cast("double").alias("value"))
    group = [*keys, "date"]
    if how == "median":
        # Buckets that have rows but no value keep their row.
        medians = exact_quantiles(rows, group, "value", [0.5], ["value"])
        return rows.select(*group).distinct().join(medians, group, "left")
    present = F.when(F.col("value").isNotNull(), F.col("_at"))
    how_to = {
        "mean": F.avg("value"),
        "first": F.min_by("value", present),
        "last": F.max_by("value", present),
    }
    return rows.groupBy(*group).agg(how_to[how].alias("value"))


def missingness(df: DataFrame, keys: Sequence[str] = ("series",), date: str = "date", value: str = "price",
                coverage: float = 0.8) -> DataFrame:
    """Rows, missing rows, missing share, low-coverage flag and span per series."""
    share = F.bround(F.count_if(F.col(value).isNull()) / F.count("*"), 4)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        share.alias("pct_missing"),
        F.min(date).alias("date_start"),
        F.max(date).alias("date_end"),
    ).withColumn("low_coverage", F.col("pct_missing") > 1 - coverage)


def date_range(df: DataFrame, date: str = "date") -> DataFrame:
    """First date, last date, dated rows; fails when 95 % of the dates are missing."""
    out = df.agg(
        F.min(date).alias("start"), F.max(date).alias("end"),
        F.count(date).alias("n_obs"), F.count("*").alias("_n"),
    )
    bad = F.col("n_obs") < 0.05 * F.col("_n")
    checked = F.when(bad, F.raise_error(F.lit("over 95% of the dates are missing")).cast("long")).otherwise(F.col("n_obs"))
    return out.select("start", "end", checked.alias("n_obs"))


def missing_cells(df: DataFrame, series: str = "series", date: str = "date", value: str = "price") -> DataFrame:
    return df.groupBy(series, date).agg(F.bool_or(F.col(value).isNull()).alias("missing"))


def column_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of non-null values per column: ``(column, coverage)``."""
    one = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], list(columns), "column", "coverage")


def coverage_with_reason(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("series",),
                         missing_allowed: int = 0) -> DataFrame:
    """Share of usable rows and the most frequent first missing column per series.

    Reasons are counted first, so the ranking window sees one row per column name;
    equal counts go to the name that sorts first.
    """
    usable = (scalars.n_missing(columns) <= missing_allowed).cast("double")
    counted = df.groupBy(*keys, scalars.first_missing(columns).alias("_reason")).agg(
        F.count("*").alias("_n"), F.sum(usable).alias("_ok")
    )
    top = F.min(F.when(F.col("_n") == F.col("_most"), F.col("_reason")))
    most = F.max(F.when(F.col("_reason").isNotNull(), F.col("_n"))).over(W.partitionBy(*keys))
    return counted.withColumn("_most", most).groupBy(*keys).agg(
        (F.sum("_ok") / F.sum("_n")).alias("coverage"), top.alias("top_reason")
    )


def date_means(df: DataFrame, date: str = "date", value: str = "ret") -> DataFrame:
    return df.groupBy(date).agg(F.count("*").alias("n_obs"), F.avg(value).alias("ret_mean"))


def coverage_table(frames: Sequence[DataFrame], series: str = "series_id", date: str = "date",
                   value: str = "ret") -> DataFrame:
    """Span and month count per series over several inputs; a month counts once."""
    rows = frames[0].where(F.col(value).isNotNull()).select(series, date)
    for f in frames[1:]:
        rows = rows.unionByName(f.where(F.col(value).isNotNull()).select(series, date))
    months = rows.distinct().groupBy(series).agg(
        F.min(date).alias("_lo"), F.max(date).alias("_hi"), F.count("*").alias("months")
    )
    return months.select(
        scalars.study_group(F.col(series)).alias("group"), scalars.display_name(F.col(series)).alias("name"),
        F.col(series), F.date_format("_lo", "yyyy-MM").alias("start"),
        F.date_format("_hi", "yyyy-MM").alias("end"), "months",
    )


def coverage_after_merge(merged: DataFrame, series: str = "series", value: str = "value",
                         floor: float = 0.40) -> DataFrame:
    share = F.avg(F.col(value).isNotNull().cast("double"))
    return merged.groupBy(series).agg(share.alias("coverage")).withColumn("low", F.col("coverage") < floor)


def shape_by_regime(df: DataFrame, value: str, threshold: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Skewness and Pearson kurtosis per regime and overall (regime NULL).

    ``threshold`` is a column or scalar subquery.  Each row is read once and feeds
    its regime and the total.
    """
    regime = F.when(F.col(value) <= threshold, F.lit("low")).otherwise(F.lit("high"))
    rows = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_x"), F.explode(F.array(regime, F.lit(None).cast("string"))).alias("regime")
    )
    return rows.groupBy(*keys, "regime").agg(
        F.count("*").alias("n"),
        F.skewness("_x").alias("skewness"),
        (F.kurtosis("_x") + 3.0).alias("kurtosis"),
    )


def ecdf_at(value: Column | str, point: Column) -> Column:
    """Share of values not above ``point`` (an aggregate)."""
    x = F.col(value) if isinstance(value, str) else value
    return F.avg((x <= point).cast("double"))


def flag_overlap(flags: DataFrame, a: str, b: str, index: str = "index", date: str = "date",
                 high: str = "high") -> DataFrame:
    """Jaccard overlap of the high states of two indices.

    One aggregation per date instead of a self join.  A date counts if both
    indices have it; NULL flags follow three-valued logic.
    """
    def flag(name: str) -> Column:
        return F.max(F.when(F.col(index) == name, F.col(high)))

    def seen(name: str) -> Column:
        return F.count_if(F.col(index) == name) > 0

    by_date = flags.where(F.col(index).isin(a, b)).groupBy(date).agg(
        flag(a).alias("_a"), flag(b).alias("_b"), (seen(a) & seen(b)).alias("_both")
    ).where("_both")
    one, two = F.col("_a") == 1, F.col("_b") == 1
    return by_date.agg(
        F.count_if(one & two).alias("both_high"), F.count_if(one | two).alias("any_high")
    ).withColumn("jaccard", F.try_divide(F.col("both_high"), F.col("any_high")))


def high_share(flags: DataFrame, index: str = "index", high: str = "high") -> DataFrame:
    return flags.where(F.col(high).isNotNull()).groupBy(index).agg(
        F.count("*").alias("n"), F.avg(F.col(high).cast("double")).alias("s_high")
    )


def share_gap(flags: DataFrame, a: str, b: str, index: str = "index", high: str = "high") -> DataFrame:
    """High-state share of ``a`` minus that of ``b``."""
    def share(name: str) -> Column:
        return F.avg(F.when(F.col(index) == name, F.col(high).cast("double")))

    return flags.agg(share(a).alias("s_a"), share(b).alias("s_b")).withColumn("gap", F.col("s_a") - F.col("s_b"))


def peak_step(df: DataFrame, keys: Sequence[str], value: str = "delta", step: str = "t") -> DataFrame:
    """Largest absolute value per group and the first step that has it."""
    size = F.abs(value)
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min_by(step, F.struct(-size, F.col(step))).alias("t_peak"), F.max(size).alias("peak_abs")
    )
