"""Shock responses per fit and the measures on their curves.

A fit row carries its coefficients, so the recursion over horizons runs per row in an
Arrow UDF without a shuffle; its H x K x K values leave as one array and become long
rows in Spark.  Everything after that is plain SQL on the long table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions import linalg

CURVE = ("model", "regime", "impulse", "response")


def _long(fits: DataFrame, flat: Column, h0: int = 0) -> DataFrame:
    cells = fits.select("model", "regime", "names", "k", F.posexplode(flat).alias("_at", "value"))
    per = F.col("k") * F.col("k")
    return cells.select(
        "model", "regime",
        F.get("names", (F.col("_at") % F.col("k")).cast("int")).alias("impulse"),
        F.get("names", F.floor((F.col("_at") % per) / F.col("k")).cast("int")).alias("response"),
        (F.floor(F.col("_at") / per) + h0).cast("int").alias("h"), "value",
    )


def _curve_udf(horizon: int, shape: str, size: float = 1.0):
    @F.pandas_udf("array<double>")
    def curves(b: pd.Series, sigma: pd.Series, k: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for bb, ss, kk, pp in zip(b, sigma, k, p):
            kk, pp = int(kk), int(pp)
            lags = linalg.split_lags(np.asarray(bb, float).reshape(kk, 1 + kk * pp), kk, pp)
            cov = np.asarray(ss, float).reshape(kk, kk)
            phi = linalg.moving_average_matrices(lags, horizon)
            sd = np.sqrt(np.diag(cov))
            if shape == "generalized":
                phi = phi @ (cov / sd)
            elif shape == "sd":
                phi = phi * (sd * size)
            elif shape == "unit":
                phi = phi * size
            out.append(phi.ravel())
        return pd.Series(out)

    return curves


def moving_average(fits: DataFrame, horizon: int) -> DataFrame:
    """Moving-average coefficients, h = 0..H."""
    return _long(fits, _curve_udf(horizon, "plain")("b", "sigma", "k", "p"))


def generalized(fits: DataFrame, horizon: int) -> DataFrame:
    """Responses to a one-sd shock that moves the other variables as the covariance says."""
    return _long(fits, _curve_udf(horizon, "generalized")("b", "sigma", "k", "p"))


def shock_responses(fits: DataFrame, horizon: int, shock: str = "unit", size: float = 1.0,
                    impact_step: int = 1) -> DataFrame:
    """Responses to a unit or sd shock.  The impact comes ``impact_step`` steps after
    h = 0 (one by default), and the rows before it are zero."""
    if shock not in ("unit", "sd"):
        raise ValueError("shock must be 'unit' or 'sd'")
    late = _long(fits, _curve_udf(horizon - impact_step, shock, size)("b", "sigma", "k", "p"), h0=impact_step)
    if not impact_step:
        return late
    start = late.where(F.col("h") == impact_step).select(
        *CURVE, F.explode(F.sequence(F.lit(0), F.lit(impact_step - 1))).alias("h"), F.lit(0.0).alias("value")
    )
    return late.unionByName(start)


def combined(responses: DataFrame) -> DataFrame:
    """Mean of the low and the high regime, as regime ``combined``."""
    return responses.where(F.col("regime").isin("low", "high")).groupBy("model", "impulse", "response", "h").agg(
        F.avg("value").alias("value")
    ).select("model", F.lit("combined").alias("regime"), "impulse", "response", "h", "value")


def regime_difference(responses: DataFrame) -> DataFrame:
    """High minus low curve and its running sum."""
    def side(regime: str) -> Column:
        return F.max(F.when(F.col("regime") == regime, F.col("value")))

    keys = ["model", "impulse", "response"]
    wide = responses.where(F.col("regime").isin("low", "high")).groupBy(*keys, "h").agg(
        side("low").alias("low"), side("high").alias("high")
    ).withColumn("diff", F.col("high") - F.col("low"))
    over = W.partitionBy(*keys).orderBy("h").rowsBetween(W.unboundedPreceding, W.currentRow)
    return wide.withColumn("cum_diff", F.sum("diff").over(over))


def peaks(responses: DataFrame, keys: Sequence[str] = CURVE) -> DataFrame:
    return responses.groupBy(*keys).agg(F.max(F.abs("value")).alias("peak"))


def half_life_from_start(responses: DataFrame, keys: Sequence[str] = CURVE, frac: float = 0.5) -> DataFrame:
    """First h at which the curve is at most ``frac`` of its maximum."""
    top = F.max(F.abs("value")).over(W.partitionBy(*keys))
    return responses.withColumn("_top", top).groupBy(*keys).agg(
        F.min(F.when((F.abs("value") <= frac * F.col("_top")) & (F.col("_top") > 0), F.col("h"))).alias("half_life")
    )


def half_life_from_peak(responses: DataFrame, keys: Sequence[str] = CURVE, frac: float = 0.5) -> DataFrame:
    """Steps from the peak to the first h at most ``frac`` of it."""
    whole = W.partitionBy(*keys)
    top = responses.withColumn("_x", F.abs("value")).withColumn("_peak", F.max("_x").over(whole)).withColumn(
        "_at", F.min_by("h", F.struct(-F.col("_x"), F.col("h"))).over(whole)
    )
    hit = (F.col("h") >= F.col("_at")) & (F.col("_x") <= frac * F.col("_peak"))
    return top.groupBy(*keys).agg((F.min(F.when(hit, F.col("h"))) - F.min("_at")).alias("half_life"))


def half_life_envelope(responses: DataFrame, keys: Sequence[str] = CURVE, frac: float = 0.6) -> DataFrame:
    """Time from the peak until the running minimum falls to ``frac`` of the peak,
    linear between steps; NULL if that never happens within the horizon."""
    whole = W.partitionBy(*keys)
    over = whole.orderBy("h")
    rows = responses.select(*keys, "h", F.abs("value").alias("_x"))
    rows = rows.withColumn("_peak", F.max("_x").over(whole)).withColumn(
        "_at", F.min_by("h", F.struct(-F.col("_x"), F.col("h"))).over(whole)
    )
    after = rows.where(F.col("h") >= F.col("_at"))
    after = after.withColumn("_env", F.min("_x").over(over.rowsBetween(W.unboundedPreceding, W.currentRow)))
    after = after.withColumn("_before", F.lag("_env").over(over))
    thr = frac * F.col("_peak")
    part = F.when(F.col("_before") == F.col("_env"), 1.0).otherwise(
        (F.col("_before") - thr) / (F.col("_before") - F.col("_env"))
    )
    crossing = F.when((F.col("h") > F.col("_at")) & (F.col("_env") <= thr) & (F.col("_before") > thr), F.col("h") - 1 + part - F.col("_at"))
    flat = F.when(F.max("_peak") <= 0, F.lit(0.0))
    return after.groupBy(*keys).agg(F.coalesce(flat, F.min(crossing)).alias("half_life"))


def group_medians(per_curve: DataFrame, groups: DataFrame, measure: str, keys: Sequence[str] = ("model", "regime")) -> DataFrame:
    """Median over impulses per response, then over the responses of a group.

    ``groups`` is ``(response, group)``.  Both medians are over at most K values.
    """
    per_response = per_curve.groupBy(*keys, "response").agg(F.median(measure).alias(measure))
    return per_response.join(groups, "response").groupBy(*keys, "group").agg(F.median(measure).alias(measure))


def persistence(responses: DataFrame, horizon: int = 24, keys: Sequence[str] = CURVE) -> DataFrame:
    """Sum of absolute responses up to the horizon."""
    return responses.where(F.col("h") <= horizon).groupBy(*keys).agg(F.sum(F.abs("value")).alias("PI"))


def amplification(responses: DataFrame) -> DataFrame:
    """Peak of the low regime over that of the high regime."""
    def top(regime: str) -> Column:
        return F.max(F.when(F.col("regime") == regime, F.abs("value")))

    return responses.groupBy("model", "impulse", "response").agg(
        top("low").alias("peak_low"), top("high").alias("peak_high")
    ).withColumn("amplification", F.try_divide("peak_low", "peak_high"))


def uplift(high: DataFrame, linear: DataFrame, groups: DataFrame) -> DataFrame:
    """High regime against the single-regime benchmark: ratio of median peaks and
    difference of median half-lives per group, over all (response, impulse) pairs."""
    def measured(df: DataFrame, tag: str) -> DataFrame:
        keys = ["model", "impulse", "response"]
        both = peaks(df, keys).join(half_life_envelope(df, keys), keys)
        return both.join(groups, "response").groupBy("model", "group").agg(
            F.median("peak").alias(f"peak_{tag}"), F.median("half_life").alias(f"hl_{tag}")
        )

    return measured(high, "hi").join(measured(linear, "lin"), ["model", "group"]).select(
        "model", "group", F.try_divide("peak_hi", "peak_lin").alias("peak_ratio"),
        (F.col("hl_hi") - F.col("hl_lin")).alias("d_half_life"),
    )


def compare_runs(a: DataFrame, b: DataFrame, labels: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Curves of two runs side by side, long form with a ``run`` column."""
    return a.withColumn("run", F.lit(labels[0])).unionByName(b.withColumn("run", F.lit(labels[1])))


def pair_index(members: DataFrame, exported: DataFrame) -> DataFrame:
    """All (impulse, response) pairs of a model and whether a curve was exported.

    ``members`` is ``(model, names)``; its names are exploded twice, so no join makes the pairs.
    """
    done = exported.select("model", "impulse", "response").distinct().withColumn("_done", F.lit(True))
    pairs = members.select("model", F.explode("names").alias("impulse"), "names").select(
        "model", "impulse", F.explode("names").alias("response")
    )
    return pairs.join(done, ["model", "impulse", "response"], "left").select(
        "model", "impulse", "response", F.concat_ws(" → ", "impulse", "response").alias("pair"),
        F.coalesce("_done", F.lit(False)).alias("exported"),
    )
