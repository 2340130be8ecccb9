"""Decomposition of scenario effects into contributions.

All keys come from :func:`joins.scenario_keys`; the uncertainty index takes part when
the tables have it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.functions.quantiles import exact_quantiles, series_quantile
from stratawave.operators.aggregate import peak_step
from stratawave.operators.joins import delta_from_baseline, salted_join, scenario_keys
from stratawave.operators.reshape import to_wide
from stratawave.operators.sets import top_n
from stratawave.operators.shares import normalise_shares

RESIDUAL = "residual"


def _with_unc(df: DataFrame, names: Sequence[str]) -> list[str]:
    return [c for c in ("uncertainty",) if c in df.columns] + list(names)


# ------------------------------------------------------------ inputs, deltas


def extract_baseline(tidy: DataFrame, variables: Sequence[str] | None = None, bounded: bool = False) -> DataFrame:
    """Median of the baseline rows per key.

    Each scenario and draw adds a row, so a key may be large: the exact median does
    not bring its rows together.  With ``bounded`` the caller states that a key has a row for
    each of a list of scenarios only; one aggregation in memory is then enough.
    """
    rows = tidy.where("is_baseline")
    if variables is not None:
        rows = rows.where(F.col("variable").isin(*variables))
    keys = _with_unc(tidy, ["regime", "variable", "t"])
    if bounded:
        return rows.groupBy(*keys).agg(series_quantile(scalars.clean_double(F.col("value").cast("double")), 0.5).alias("value")).where("value IS NOT NULL")
    return exact_quantiles(rows, keys, "value", [0.5], ["value"])


def extract_shocked(tidy: DataFrame, scenarios: Sequence[str] | None = None,
                    variables: Sequence[str] | None = None) -> DataFrame:
    rows = tidy.where(~F.col("is_baseline"))
    if scenarios is not None:
        rows = rows.where(F.col("scenario").isin(*scenarios))
    if variables is not None:
        rows = rows.where(F.col("variable").isin(*variables))
    return rows.select(*scenario_keys(tidy), "value")


def delta_table(shocked: DataFrame, baseline: DataFrame) -> DataFrame:
    """Shocked minus baseline, summed per key."""
    deltas = delta_from_baseline(shocked, baseline)
    return deltas.groupBy(*scenario_keys(deltas)).agg(F.sum("delta").alias("delta"))


# ------------------------------------------------------------ contributions


def by_shock_paths(single_paths: DataFrame, baseline: DataFrame, shock_map: DataFrame, delta: DataFrame) -> DataFrame:
    """Weight times the delta of each single-shock path, for the scenarios of ``delta``.

    ``single_paths`` is ``(shock_id, regime, variable, t, value)``, ``shock_map`` is
    ``(scenario, shock_id, weight)``.
    """
    single = delta_from_baseline(single_paths, baseline, keep=("shock_id",))
    weight = F.col("weight") if "weight" in shock_map.columns else F.lit(1.0)
    used = shock_map.join(delta.select("scenario").distinct(), "scenario", "left_semi")
    used = used.select("scenario", "shock_id", weight.alias("_w"))
    return salted_join(single, used, ["shock_id"], ["regime", "variable", "t"]).select(
        *_with_unc(single, ["scenario", "shock_id", "regime", "variable", "t"]),
        (F.col("_w") * F.col("delta")).alias("contribution"),
    )


def by_shares(delta: DataFrame, shares: DataFrame) -> DataFrame:
    """Normalised variance share times delta.

    The shares hold for every scenario alike, so they join on regime, variable and step
    and need not be crossed with the scenarios first.
    """
    norm = normalise_shares(shares).withColumnsRenamed({"response": "variable", "impulse": "shock_id"})
    keys = [c for c in ("uncertainty", "regime", "variable", "t") if c in norm.columns and c in delta.columns]
    return delta.join(norm, keys).select(
        *_with_unc(delta, ["scenario", "shock_id", "regime", "variable", "t"]),
        (F.col("fevd_share") * F.col("delta")).alias("contribution"),
    )


def reconcile(contrib: DataFrame, delta: DataFrame, method: str = "residual", tol: float = 1e-10) -> DataFrame:
    """Make contributions add up to the delta.

    ``residual`` adds a row for what is missing beyond ``tol``; ``scale`` spreads it in
    proportion, and puts the whole delta into a residual where nothing can be scaled.
    """
    if method not in ("residual", "scale"):
        raise ValueError("method must be 'residual' or 'scale'")
    keys = scenario_keys(contrib, delta)
    # The shocks of one key are at most the model's variables: they travel as one array.
    per = contrib.groupBy(*keys).agg(
        F.collect_list(F.struct("shock_id", "contribution")).alias("_c"), F.sum("contribution").alias("_total")
    ).join(delta.select(*keys, "delta"), keys, "left").withColumn("_rest", F.col("delta") - F.col("_total"))
    big = F.abs("_total") > tol

    def residual(cond: Column, amount: str) -> Column:
        row = F.struct(F.lit(RESIDUAL).alias("shock_id"), F.col(amount).alias("contribution"))
        return F.filter(F.array(F.when(cond, row)), lambda x: x.isNotNull())

    if method == "residual":
        rows = F.concat("_c", residual(F.abs("_rest") > tol, "_rest"))
    else:
        factor = F.when(big & F.col("_rest").isNotNull(), 1 + F.try_divide("_rest", "_total")).otherwise(F.lit(1.0))
        scaled = F.transform("_c", lambda c: F.struct(
            c["shock_id"].alias("shock_id"), (c["contribution"] * F.col("_f")).alias("contribution")
        ))
        per = per.withColumn("_f", factor)
        rows = F.concat(scaled, residual(~big & (F.abs("delta") > tol), "delta"))
    return per.select(*keys, F.inline(rows))


def decompose(shocked: DataFrame, baseline: DataFrame, single_paths: DataFrame | None = None,
              shock_map: DataFrame | None = None, shares: DataFrame | None = None, method: str = "auto",
              how: str = "residual", tol: float = 1e-10) -> dict[str, DataFrame]:
    """Delta, contributions, reconciled contributions and their summary."""
    delta = delta_table(shocked, baseline)
    chosen = ("pathwise" if single_paths is not None else "fevd") if method == "auto" else method
    if chosen == "pathwise":
        if shock_map is None:
            shock_map = delta.select("scenario", F.col("scenario").alias("shock_id")).distinct().withColumn("weight", F.lit(1.0))
        contrib = by_shock_paths(single_paths, baseline, shock_map, delta)
    elif chosen == "fevd":
        if shares is None:
            raise ValueError("method 'fevd' needs shares")
        contrib = by_shares(delta, shares)
    else:
        raise ValueError(f"unknown method {method!r}")
    contrib = contrib.withColumn("method", F.lit(chosen))
    done = reconcile(contrib, delta, how, tol)
    return {"delta": delta, "contrib": contrib, "reconciled": done, "summary": shock_summary(done)}


def shock_summary(contrib: DataFrame) -> DataFrame:
    """Sum, absolute sum and largest absolute contribution per shock."""
    return contrib.groupBy(*_with_unc(contrib, ["scenario", "variable", "shock_id"])).agg(
        F.sum("contribution").alias("sum_contribution"),
        F.sum(F.abs("contribution")).alias("l1_contribution"),
        F.max(F.abs("contribution")).alias("max_abs_contribution"),
    )


def by_regime(delta: DataFrame, metric: str = "abs") -> DataFrame:
    """Total and share of each regime per scenario and variable."""
    size = F.abs("delta") if metric == "abs" else F.col("delta")
    keys = _with_unc(delta, ["scenario", "variable"])
    agg = delta.groupBy(*keys, "regime").agg(F.sum(size).alias("total"))
    grand = F.sum("total").over(W.partitionBy(*keys))
    return agg.withColumn("_g", grand).withColumn(
        "share", F.when(F.col("_g") > 0, F.col("total") / F.col("_g")).otherwise(0.0)
    ).drop("_g")


def shapley(single_delta: DataFrame, shock_map: DataFrame) -> DataFrame:
    """Shapley value of each shock under superposition, for any number of shocks.

    Effects add up, so a shock changes a path by its weighted delta whichever shocks are there before it: the mean over
    all orders is that delta.
    """
    keys = _with_unc(single_delta, ["regime", "variable", "t"])
    joined = salted_join(single_delta, shock_map, ["shock_id"], ["regime", "variable", "t"])
    return joined.select("scenario", "shock_id", *keys, F.lit("exact").alias("method"), (F.col("weight") * F.col("delta")).alias("shapley"))


def shapley_sampled(single_delta: DataFrame, shock_map: DataFrame, n_perm: int = 512, seed: int = 1) -> DataFrame:
    """Mean marginal change of each shock over ``n_perm`` orders, sorted by hashes of (seed, scenario, order, shock).

    A marginal change is the running sum of weighted deltas with the shock minus without it.  Every path is repeated for
    every order: :func:`shapley` gives the same value under superposition, and this shows it.
    """
    drawn = shock_map.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n_perm))))
    by_hash = W.partitionBy("scenario", "perm").orderBy(F.xxhash64(F.lit(seed), "scenario", "perm", "shock_id"), "shock_id")
    orders = drawn.withColumn("place", F.row_number().over(by_hash))
    ordered = salted_join(single_delta, orders, ["shock_id"], ["regime", "variable", "t"]).withColumn(
        "_d", F.col("weight") * F.col("delta"))
    keys = _with_unc(single_delta, ["regime", "variable", "t"])
    path = W.partitionBy("scenario", "perm", *keys).orderBy("place")
    with_it = F.sum("_d").over(path.rowsBetween(W.unboundedPreceding, W.currentRow))
    without = F.coalesce(F.sum("_d").over(path.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return ordered.withColumn("_m", with_it - without).groupBy("scenario", "shock_id", *keys).agg(
        F.lit("sampled").alias("method"), F.avg("_m").alias("shapley"), F.count("*").alias("perms_used"))


def mass_balance(contrib: DataFrame, delta: DataFrame, tol: float = 1e-10, include_residual: bool = False) -> DataFrame:
    """Per key: delta, sum of contributions, what is left and whether it is within ``tol``."""
    keys = scenario_keys(contrib, delta)
    rows = contrib if include_residual else contrib.where(F.col("shock_id") != RESIDUAL)
    sums = rows.groupBy(*keys).agg(F.sum("contribution").alias("sum_contrib"))
    left = F.col("delta") - F.col("sum_contrib")
    return delta.select(*keys, "delta").join(sums, keys).withColumns(
        {"residual": left, "within_tol": F.abs(left) <= tol}
    )


def mass_report(balance: DataFrame) -> DataFrame:
    return balance.agg(
        F.count("*").alias("n_keys"), F.count_if(~F.col("within_tol")).alias("n_violations"),
        F.max(F.abs("residual")).alias("max_abs_residual"),
    ).withColumn("ok", F.col("n_violations") == 0)


# ------------------------------------------------------------------ metrics


def energy(delta: DataFrame, decay: float = 0.90) -> DataFrame:
    """Squared sum, decay-weighted absolute sum and peak of each path."""
    return delta.groupBy(*_with_unc(delta, ["scenario", "regime", "variable"])).agg(
        F.sum(F.pow("delta", F.lit(2.0))).alias("energy"),
        F.sum(F.pow(F.lit(decay), F.col("t") - 1) * F.abs("delta")).alias("persistence"),
        F.max(F.abs("delta")).alias("peak_abs"),
    )


def peak_horizons(delta: DataFrame) -> DataFrame:
    return peak_step(delta, _with_unc(delta, ["scenario", "regime"]))


def _at(table: DataFrame, delta: DataFrame | None, at: str) -> DataFrame:
    """Rows at the peak step, or at the last step, of their scenario and regime."""
    keys = _with_unc(table, ["scenario", "regime"])
    if at == "peak":
        peaks = peak_horizons(delta).select(*keys, F.col("t_peak").alias("t"))
        return table.join(peaks, [*keys, "t"], "left_semi")
    return table.join(table.groupBy(*keys).agg(F.max("t").alias("t")), [*keys, "t"], "left_semi")


def _top3(value: str, keys: Sequence[str]) -> Column:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last()))
    return rank <= 3


def dispersion_at_peak(delta: DataFrame) -> DataFrame:
    """Spread of the absolute deltas over variables at the peak, and the share of the top three."""
    keys = _with_unc(delta, ["scenario", "regime"])
    at = F.min_by("t", F.struct(-F.abs("delta"), F.col("t"))).over(W.partitionBy(*keys))
    rows = delta.withColumn("_at", at).where(F.col("t") == F.col("_at")).withColumn("_a", F.abs("delta"))
    rows = rows.withColumn("_top", _top3("_a", keys))
    return rows.groupBy(*keys).agg(
        F.stddev_samp("_a").alias("csd_abs"),
        F.try_divide(F.sum(F.when(F.col("_top"), F.col("_a"))), F.sum("_a")).alias("top3_share_abs"),
    )


def concentration(contrib: DataFrame, delta: DataFrame | None = None, at: str = "peak") -> DataFrame:
    """Herfindahl index and top-three share of the contributions."""
    keys = _with_unc(contrib, ["scenario", "regime"])
    rows = _at(contrib, delta, at).withColumn("_w", F.abs("contribution"))
    total = F.sum("_w").over(W.partitionBy(*keys))
    rows = rows.withColumn("_t", total).withColumn("_s", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(0.0))
    rows = rows.withColumn("_top", _top3("_s", keys))
    return rows.groupBy(*keys).agg(
        F.sum(F.col("_s") * F.col("_s")).alias("herfindahl"), F.sum(F.when(F.col("_top"), F.col("_s"))).alias("top3_share")
    )


def index_agreement(contrib: DataFrame, indices: Sequence[str], delta: DataFrame | None = None, at: str = "peak") -> DataFrame:
    """Spearman correlation of shock totals between pairs of indices.

    ``indices`` is the model list; a shock an index lacks counts zero.  Totals are
    pivoted to one row per shock; ranks are average ranks.
    """
    picked = _at(contrib, delta, at)
    totals = to_wide(
        picked.groupBy("scenario", "regime", "shock_id", "uncertainty").agg(F.sum("contribution").alias("v")),
        ["scenario", "regime", "shock_id"], "uncertainty", "v", indices,
    ).fillna(0.0, subset=list(indices))
    present = picked.groupBy("scenario", "regime").agg(F.collect_set("uncertainty").alias("_have"))

    def rank(c: str) -> Column:
        group = W.partitionBy("scenario", "regime")
        low = F.rank().over(group.orderBy(c))
        same = F.count("*").over(W.partitionBy("scenario", "regime", c))
        return low + (same - 1) / 2.0

    ranked = totals.withColumns({f"_r_{c}": rank(c) for c in indices})
    names = sorted(indices)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    rhos = ranked.groupBy("scenario", "regime").agg(
        *[F.corr(f"_r_{a}", f"_r_{b}").alias(f"{a}~{b}") for a, b in pairs]
    ).join(present, ["scenario", "regime"])
    rows = F.array(*[
        F.struct(F.lit(f"{a}~{b}").alias("pair"), F.col(f"`{a}~{b}`").alias("rho"),
                 (F.array_contains("_have", a) & F.array_contains("_have", b)).alias("_ok"))
        for a, b in pairs
    ])
    return rhos.select("scenario", "regime", F.inline(rows)).where("_ok").drop("_ok")


# ------------------------------------------------------------ output tables


def contributions_wide(contrib: DataFrame, shocks: Sequence[str]) -> DataFrame:
    return to_wide(contrib, scenario_keys(contrib), "shock_id", "contribution", shocks)


def totals_by_shock(contrib: DataFrame) -> DataFrame:
    """Sum and absolute sum per shock, with its place by absolute sum of effects."""
    keys = _with_unc(contrib, ["scenario", "variable"])
    agg = contrib.groupBy(*keys, "shock_id").agg(
        F.sum("contribution").alias("total"), F.sum(F.abs("contribution")).alias("l1")
    )
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.abs("total").desc(), "shock_id"))
    return agg.withColumn("place", place)


def terminal_top(contrib: DataFrame, n: int = 10, include_residual: bool = True) -> DataFrame:
    """Largest contributions at the last step of each scenario and variable."""
    keys = _with_unc(contrib, ["scenario", "variable"])
    rows = contrib if include_residual else contrib.where(F.col("shock_id") != RESIDUAL)
    sums = rows.groupBy(*keys, "t", "shock_id").agg(F.sum("contribution").alias("contribution"))
    last = F.max("t").over(W.partitionBy(*keys))
    at_end = sums.withColumn("_last", last).where(F.col("t") == F.col("_last")).drop("_last", "t")
    return top_n(at_end, keys, F.abs("contribution"), n, ties=["shock_id"])


def auto_horizon(contrib: DataFrame, by: str = "l1") -> DataFrame:
    """Step with the largest absolute or net total per scenario and variable."""
    keys = _with_unc(contrib, ["scenario", "variable"])
    sums = contrib.groupBy(*keys, "t").agg(
        F.sum(F.abs("contribution")).alias("l1"), F.abs(F.sum("contribution")).alias("net")
    )
    return sums.groupBy(*keys).agg(F.min_by("t", F.struct(-F.col(by), F.col("t"))).alias("t"))


def waterfall(contrib: DataFrame, top: int = 8, top_variables: int | None = 12, horizon: int | None = None,
              by: str = "l1") -> DataFrame:
    """Bars of a waterfall: top shocks and Other at the chosen step, with running offsets.

    One aggregation and windows over it; a window holds the steps and shocks of one
    scenario and variable.
    """
    keys = _with_unc(contrib, ["scenario", "variable"])
    whole = W.partitionBy(*keys)
    agg = contrib.groupBy(*keys, "t", "shock_id").agg(
        F.sum("contribution").alias("contribution"), F.sum(F.abs("contribution")).alias("_l1")
    )
    if horizon is not None:
        agg = agg.where(F.col("t") == horizon)
    else:
        step = W.partitionBy(*keys, "t")
        size = F.sum("_l1").over(step) if by == "l1" else F.abs(F.sum("contribution").over(step))
        agg = agg.withColumn("_size", size).withColumn("_at", F.min_by("t", F.struct(-F.col("_size"), F.col("t"))).over(whole))
        agg = agg.where(F.col("t") == F.col("_at"))
    place = F.row_number().over(whole.orderBy(F.abs("contribution").desc(), "shock_id"))
    bars = agg.withColumn("_rest", place > top).groupBy(
        *keys, "_rest", F.when(F.col("_rest"), "Other").otherwise(F.col("shock_id")).alias("shock_id")
    ).agg(F.sum("contribution").alias("contribution")).drop("_rest")
    if top_variables is not None:
        bars = bars.withColumn("_l1", F.sum(F.abs("contribution")).over(whole))
        rank = F.dense_rank().over(W.partitionBy(*[k for k in keys if k != "variable"]).orderBy(F.col("_l1").desc(), "variable"))
        bars = bars.withColumn("_v", rank).where(F.col("_v") <= top_variables).drop("_v", "_l1")
    over = whole.orderBy("contribution", "shock_id")
    upto = F.sum("contribution").over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    bars = bars.withColumns({"id": F.row_number().over(over), "y1": upto})
    return bars.withColumn("y0", F.coalesce(F.lag("y1").over(over), F.lit(0.0)))


def top_variables_by_size(contrib: DataFrame, n: int) -> DataFrame:
    """Variables with the largest absolute sum per scenario."""
    keys = _with_unc(contrib, ["scenario"])
    size = contrib.groupBy(*keys, "variable").agg(F.sum(F.abs("contribution")).alias("l1"))
    return top_n(size, keys, F.col("l1"), n, ties=["variable"])


def stacked(contrib: DataFrame, top: int = 8) -> DataFrame:
    """Contributions over t with the small shocks folded into Other, and the net line."""
    keys = _with_unc(contrib, ["scenario", "variable"])
    agg = contrib.groupBy(*keys, "shock_id", "t").agg(F.sum("contribution").alias("contribution"))
    sized = agg.withColumn("_l1", F.sum(F.abs("contribution")).over(W.partitionBy(*keys, "shock_id")))
    rank = F.dense_rank().over(W.partitionBy(*keys).orderBy(F.col("_l1").desc(), "shock_id"))
    named = sized.withColumn("_r", rank).withColumn(
        "shock_group", F.when(F.col("_r") <= top, F.col("shock_id")).otherwise("Other")
    )
    folded = named.groupBy(*keys, "t", "shock_group").agg(F.sum("contribution").alias("contribution"))
    return folded.withColumn("net", F.sum("contribution").over(W.partitionBy(*keys, "t")))


def share_stack(shares: DataFrame, top_impulses: int = 8, top_responses: int = 12) -> DataFrame:
    """Variance shares for a stack: top impulses overall, top responses per regime, the rest Other."""
    norm = normalise_shares(shares)
    impulses = norm.groupBy("impulse").agg(F.sum("fevd_share").alias("_s")).orderBy(
        F.col("_s").desc(), "impulse"
    ).limit(top_impulses).select("impulse", F.lit(True).alias("_in"))
    keys = _with_unc(norm, ["regime"])
    size = norm.groupBy(*keys, "response").agg(F.sum(F.abs("fevd_share")).alias("_l1"))
    responses = top_n(size, keys, F.col("_l1"), top_responses, ties=["response"]).select(*keys, "response")
    named = norm.join(impulses, "impulse", "left").withColumn(
        "impulse_group", F.when(F.col("_in"), F.col("impulse")).otherwise("Other")
    ).join(responses, [*keys, "response"], "left_semi")
    return named.groupBy(*keys, "response", "t", "impulse_group").agg(F.sum("fevd_share").alias("share"))


def with_units(table: DataFrame, value: str = "contribution") -> DataFrame:
    """Values in the unit that fits the largest absolute value of the table."""
    top = table.agg(F.max(F.abs(value)).alias("m")).select("m").scalar()
    return table.withColumn("_u", scalars.unit_scale(top)).withColumns({
        f"{value}_scaled": F.col(value) * F.col("_u.scale"), "unit": F.col("_u.suffix")
    }).drop("_u")
