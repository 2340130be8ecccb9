"""Comparison tables and three-level scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.operators.shares import share_wedge
from stratawave.sources.writers import latest

# The three marks.
YES, PARTLY, NO, NONE = "✓", "△", "✗", "–"


def index_wedge(table: DataFrame, value: str, out: str, a: str = "Volatility", b: str = "JLN",
                keys: Sequence[str] = ("group",)) -> DataFrame:
    """High-regime measure of one index minus that of the other, per key."""
    high = table.where(F.upper("regime") == "H").withColumn("proxy", scalars.fold_proxy(F.col("proxy")))

    def side(name: str) -> Column:
        return F.median(F.when(F.col("proxy") == name, F.col(value)))

    return high.groupBy(*keys).agg((side(a) - side(b)).alias(out))


def wedges(shares: DataFrame, half_lives: DataFrame, persistence: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    """Differences of the two indices per key: shares at 12 and 24, persistence, half-life."""
    keys = list(keys)
    dd12 = share_wedge(shares, 12, keys=keys).select(*keys, F.col("value").alias("dd12"))
    dd24 = share_wedge(shares, 24, keys=keys).select(*keys, F.col("value").alias("dd24"))
    dpi = index_wedge(persistence, "PI", "dpi", keys=keys)
    dhl = index_wedge(half_lives, "half_life", "dhl", keys=keys)
    return dd12.join(dd24, keys, "full").join(dpi, keys, "left").join(dhl, keys, "left")


def graded(x: Column, good: float, fair: float) -> Column:
    """Mark of a magnitude; a missing one is in the middle."""
    return F.when(x.isNull(), PARTLY).when(F.abs(x) >= good, YES).when(F.abs(x) >= fair, PARTLY).otherwise(NO)


def score_shares(d12: Column, d24: Column) -> Column:
    top = F.greatest(F.abs(d12), F.abs(d24))
    same = F.signum(d12) == F.signum(d24)
    return F.when(d12.isNull() | d24.isNull(), PARTLY).when(same & (top >= 0.03), YES).when(top >= 0.01, PARTLY).otherwise(NO)


def score_horizon(d12: Column, d24: Column) -> Column:
    rel = F.abs(d24 - d12) / F.greatest(F.abs(d12), F.lit(1e-6))
    same = F.signum(d12) == F.signum(d24)
    return F.when(d12.isNull() | d24.isNull(), PARTLY).when(~same, NO).when(rel <= 0.5, YES).otherwise(PARTLY)


def diagnostics_mark(selection: DataFrame) -> DataFrame:
    """One mark for the models: all roots below one and all whiteness p at least 0.01 for
    one index is enough; roots alone give the middle mark."""
    newest = latest(selection, ["window", "proxy"], "run_at")
    family = F.when(F.lower("proxy").isin("vxo_vix", "vix", "vol", "vxo"), "vol").when(F.lower("proxy") == "jln", "jln")
    stable = F.bool_and(F.coalesce((F.col("lambda_max_L") < 1) & (F.col("lambda_max_H") < 1), F.lit(False)))
    white = F.bool_and(F.coalesce((F.col("lb_p_L") >= 0.01) & (F.col("lb_p_H") >= 0.01), F.lit(False)))
    per = newest.withColumn("_f", family).where(F.col("_f").isNotNull()).groupBy("_f").agg(
        stable.alias("_stable"), white.alias("_white")
    )
    return per.agg(
        F.coalesce(F.bool_or(F.col("_stable") & F.col("_white")), F.lit(False)).alias("_pass"),
        F.coalesce(F.bool_or("_stable"), F.lit(False)).alias("_any"), F.count("*").alias("_n"),
    ).select(F.when(F.col("_pass"), YES).when(F.col("_any"), PARTLY).otherwise(NO).alias("mark"))


def splice_mark(selection: DataFrame) -> DataFrame:
    """Mark of the change in the high share between the long and the spliced window."""
    vol = selection.where(F.lower("proxy").isin("vxo_vix", "vix", "vol"))

    def newest(pattern: str) -> Column:
        hit = F.col("window").rlike(pattern)
        return F.max_by("s_H", F.when(hit, F.col("run_at")))

    gap = vol.agg(newest("1986.*2025").alias("_ext"), newest("1990").alias("_w90"))
    diff = F.abs(F.col("_ext") - F.col("_w90"))
    return gap.select(
        F.when(diff.isNull(), NONE).when(diff <= 0.02, YES).when(diff <= 0.05, PARTLY).otherwise(NO).alias("mark")
    )


def robustness(wedge_table: DataFrame, selection: DataFrame, keys: Sequence[str] = ("group",)) -> DataFrame:
    """Marks per key."""
    d12, d24 = F.col("dd12"), F.col("dd24")
    return wedge_table.select(
        *keys, score_shares(d12, d24).alias("dd"), score_horizon(d12, d24).alias("horizon"),
        graded(F.col("dpi"), 0.15, 0.05).alias("d_pi"), graded(F.col("dhl"), 0.05, 0.02).alias("d_half_life"),
        diagnostics_mark(selection).scalar().alias("diagnostics"), splice_mark(selection).scalar().alias("splice"),
    )


def run_info(spark: SparkSession, values: dict[str, str]) -> DataFrame:
    """Key and value rows that describe a run."""
    return spark.createDataFrame(sorted(values.items()), "key string, value string")
