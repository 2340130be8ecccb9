"""Variance shares (forecast-error variance decompositions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.lookups import PROXY_SYNONYMS


def variance_shares(responses: DataFrame, horizon: int | None = None, weights: DataFrame | None = None,
                    keys: Sequence[str] = ("regime",), step: str = "h", value: str = "value",
                    floor: float | None = None) -> DataFrame:
    """Running share of each impulse in the squared response: ``(keys, response, impulse, t, fevd_share)``.

    ``weights`` is ``(impulse, var_w)`` shock variances.  A zero denominator gives share
    0, or is raised to ``floor`` when that is set.
    """
    keys = list(keys)
    rows = responses.where(F.col(step) >= 0)
    if horizon is not None:
        rows = rows.where(F.col(step) <= horizon)
    w = F.lit(1.0)
    if weights is not None:
        rows, w = rows.join(weights.select("impulse", "var_w"), "impulse"), F.col("var_w")
    over = W.partitionBy(*keys, "response", "impulse").orderBy(step).rowsBetween(W.unboundedPreceding, W.currentRow)
    numer = F.sum(F.col(value) * F.col(value) * w).over(over)
    rows = rows.select(*keys, "response", "impulse", F.col(step).alias("t"), numer.alias("_n"))
    total = F.sum("_n").over(W.partitionBy(*keys, "response", "t"))
    if floor is not None:
        share = F.col("_n") / F.greatest(F.col("_d"), F.lit(floor))
    else:
        share = F.when(F.col("_d") > 0, F.col("_n") / F.col("_d")).otherwise(0.0)
    return rows.withColumn("_d", total).select(*keys, "response", "impulse", "t", share.alias("fevd_share"))


def shares_per_step(responses: DataFrame, variables: DataFrame, regimes: Sequence[str] = ("combined",),
                    horizon: int | None = None) -> DataFrame:
    """Shares for every step, regime and index, restricted to the model's variables that
    occur in the scenario results.  Step 1 is the first row of the curves."""
    keep = variables.select("uncertainty", "variable").distinct()
    rows = responses.where(F.col("regime").isin(*regimes))
    rows = rows.join(keep.withColumnRenamed("variable", "response"), ["uncertainty", "response"], "left_semi")
    rows = rows.join(keep.withColumnRenamed("variable", "impulse"), ["uncertainty", "impulse"], "left_semi")
    rows = rows.withColumn("t", F.col("h") + 1)
    return variance_shares(rows, horizon, keys=["uncertainty", "regime"], step="t", floor=2.220446049250313e-16)


def normalise_shares(shares: DataFrame) -> DataFrame:
    """Sum duplicates, then scale to one per response and step."""
    keys = [c for c in ("uncertainty", "regime", "response", "impulse", "t") if c in shares.columns]
    base = [c for c in keys if c != "impulse"]
    summed = shares.groupBy(*keys).agg(F.sum("fevd_share").alias("fevd_share"))
    total = F.sum("fevd_share").over(W.partitionBy(*base))
    return summed.withColumn("_t", total).withColumn(
        "fevd_share", F.when(F.col("_t") > 0, F.col("fevd_share") / F.col("_t")).otherwise(0.0)
    ).drop("_t")


def group_shares(responses: DataFrame, impulse_groups: DataFrame, horizons: Sequence[int] = (12, 24),
                 keys: Sequence[str] = ("model", "regime")) -> DataFrame:
    """Share of a group's impulses up to each horizon, averaged over all responses.

    Each row feeds every horizon it lies within; the squares are summed per response and
    group, so what follows has one row per group.
    """
    keys = list(keys)
    rows = responses.withColumn("horizon", F.explode(F.filter(
        F.array(*[F.lit(int(h)) for h in horizons]), lambda x: F.col("h") <= x
    )))
    sums = rows.join(impulse_groups.select("impulse", "group"), "impulse").groupBy(*keys, "horizon", "response", "group").agg(
        F.sum(F.col("value") * F.col("value")).alias("_n")
    )
    total = F.sum("_n").over(W.partitionBy(*keys, "horizon", "response"))
    return sums.withColumn("_s", F.try_divide(F.col("_n"), total)).groupBy(*keys, "horizon", "group").agg(
        F.avg("_s").alias("share")
    )


def trivial_shares(delta: DataFrame) -> DataFrame:
    """Share one for a single impulse ``total``."""
    keys = [c for c in ("uncertainty", "regime", "t") if c in delta.columns]
    return delta.select(*keys, F.col("variable").alias("response")).distinct().withColumns(
        {"impulse": F.lit("total"), "fevd_share": F.lit(1.0)}
    )


def share_wedge(shares: DataFrame, horizon: int, a: str = "Volatility", b: str = "JLN",
                synonyms: dict[str, str] = PROXY_SYNONYMS, horizons: Sequence[int] = (12, 24),
                keys: Sequence[str] = ("group",)) -> DataFrame:
    """(high - low) of index ``a`` minus (high - low) of index ``b`` per key, at the
    available horizon nearest to ``horizon``."""
    nearest = min(horizons, key=lambda h: (abs(h - horizon), h))
    folded = shares.where(F.col("horizon") == nearest).withColumn("proxy", scalars.fold_proxy(F.col("proxy"), synonyms))

    def cell(proxy: str, regime: str) -> Column:
        return F.max(F.when((F.col("proxy") == proxy) & (F.upper("regime") == regime), F.col("share")))

    return folded.groupBy(*keys).agg(
        ((cell(a, "H") - cell(a, "L")) - (cell(b, "H") - cell(b, "L"))).alias("value")
    ).withColumn("horizon", F.lit(nearest))
