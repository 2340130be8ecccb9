"""The stages of a run, from long prices to scores, as functions over DataFrames.

Each stage is lazy except where it says it checkpoints: a small derived table that
several later steps read.  ``write`` puts any of the returned tables to a folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.operators import aggregate, checks, clean, contrib, fit, joins, reshape, responses, scenarios, series
from stratawave.operators import shares as S
from stratawave.operators import states as R
from stratawave.session import cut_lineage
from stratawave.sources import readers, writers


@dataclass(frozen=True)
class SearchConfig:
    """Options of the model search."""

    lags: Sequence[int] = (2, 3, 4)
    delays: Sequence[int] = (1, 2)
    trim: float = 0.15
    ngrid: int = 100
    criterion: str = "BIC"
    min_share: float = 0.15
    min_obs: int = 30
    standardize: bool = True
    smooth: int = 3


def panel(prices: DataFrame, members: Sequence[str] | None = None, min_obs: int = 180,
          volatility: str = "squared") -> DataFrame:
    """Long prices ``(date, series, price)`` to the canonical panel of the study set."""
    if members is not None:
        prices = clean.study_set(prices, members)
    kept = clean.complete_series(prices, min_obs)[0]
    return clean.canonical_panel(series.volatility_proxy(series.panel_returns(kept), volatility))


def index_months(raw: DataFrame, index: str, how: str = "mean", anchor: str = "start") -> DataFrame:
    """One index source of any layout to monthly ``(index, date, value)``."""
    date, value = readers.resolve_columns(raw.columns, index, readers.numeric_columns(raw))
    rows = raw.select(
        scalars.index_name(F.lit(index), to_upper=False).alias("index"), F.col(date).alias("date"),
        scalars.coerce_number(F.col(value)).alias("value"),
    )
    return aggregate.bucket(rows, ["index"], "date", "value", how, anchor).select("index", "date", "value")


def model_input(panel_table: DataFrame, index: DataFrame, start: str | None = None, end: str | None = None,
                missing_allowed: int = 0, trim: bool = True) -> dict[str, DataFrame]:
    """Panel with one index: usable rows, coverage per series, means per date, checks."""
    if trim:
        panel_table = clean.trim_to_index(panel_table, index)
    merged = clean.date_window(joins.merge_index(panel_table, index), start, end)
    needed = ["ret", "value"]
    rows = merged.where(clean.row_mask(needed, missing_allowed))
    return {
        "rows": rows,
        "coverage": aggregate.coverage_with_reason(merged, needed, ["series_id"], missing_allowed),
        "date_means": aggregate.date_means(rows),
        "match": joins.match_rate(merged),
        "checks": checks.panel_checks(rows),
    }


def estimate(returns: DataFrame, members: DataFrame, drivers: DataFrame, config: SearchConfig = SearchConfig()) -> dict[str, DataFrame]:
    """Search, fit and diagnose every model.

    ``returns`` is ``(series, date, ret)``, ``members`` ``(model, series, pos)`` and
    ``drivers`` ``(model, date, q)``.  The model vectors, the selected spec and the fits
    are checkpointed.
    """
    c = config
    vectors = cut_lineage(fit.model_vectors(returns, members, drivers, c.standardize, c.smooth))
    spec = cut_lineage(fit.search_threshold(vectors, c.lags, c.delays, c.trim, c.ngrid, c.criterion, c.min_share, c.min_obs))
    found = spec.where(F.col("issue").isNull())
    rows = fit.regime_rows(vectors, found, c.lags, c.delays)
    fits = cut_lineage(fit.ols(rows))
    table = fit.fitted(rows, fits)
    stable = fit.stability(fits)
    path = rows.select("model", "date", "q", F.when(F.col("regime") == "low", 1).otherwise(2).alias("state"))
    return {
        "vectors": vectors, "spec": found, "failed": spec.where(F.col("issue").isNotNull()), "rows": rows, "fits": fits,
        "coefficients": fit.coefficients(fits), "covariance": fit.square_table(fits), "equations": fit.equation_table(fits),
        "fitted": table, "stability": stable, "whiteness": fit.ljung_box(table), "states": path,
        "registry": fit.model_registry(found, stable),
    }


def pooled_benchmark(vectors: DataFrame, lags: int) -> DataFrame:
    """Single-regime fits of the same models, covariance with residual degrees of freedom."""
    return fit.ols(fit.pooled_rows(vectors, lags), "resid")


def regime_dynamics(path: DataFrame, keys: Sequence[str] = ("model",), min_len: int = 1, draws: int = 2000,
                    roots: DataFrame | None = None) -> dict[str, DataFrame]:
    """Spells, transitions, bootstrap interval and the one-row summary of state paths.

    ``roots`` (keys, regime, rho) are those of the fits, as :func:`fit.stability` gives them.

    The paths (one row per step) are checkpointed, as every table here reads them.
    """
    if min_len > 1:
        path = R.smooth_short_spells(path, min_len, keys)
    path = cut_lineage(path)
    spells = R.spells(path, keys)
    probs = R.transition_probs(R.transition_counts(path, keys))
    return {
        "spells": spells, "spell_summary": R.spell_summary(spells, keys), "transitions": R.tidy_transitions(probs, keys),
        "chain": R.chain_summary(R.renormalize(probs)), "interval": R.persistence_interval(probs, keys),
        "bootstrap": R.bootstrap_transitions(path, R.block_length(spells, keys), draws, keys),
        "summary": R.regime_statistics(path, spells, probs, roots, keys=keys),
    }


def response_tables(fits: DataFrame, groups: DataFrame, horizon: int = 36) -> dict[str, DataFrame]:
    """Curves and their group summaries; ``groups`` is ``(response, group)``."""
    curves = responses.generalized(fits, horizon)
    short = curves.where(F.col("h") <= 24)
    return {
        "curves": curves, "difference": responses.regime_difference(curves), "amplification": responses.amplification(curves),
        "half_life": responses.group_medians(responses.half_life_envelope(curves), groups, "half_life"),
        "persistence": responses.group_medians(responses.persistence(short), groups, "PI"),
        "group_shares": S.group_shares(curves, groups.withColumnRenamed("response", "impulse")),
    }


def scenario_kernels(fits: DataFrame, horizon: int, shock: str = "unit", index_of: Mapping[str, str] | None = None) -> DataFrame:
    """Kernels ``(uncertainty, regime, impulse, response, h, value)`` of the fitted models,
    the combined regime included.  ``index_of`` names the index of a model."""
    curves = responses.shock_responses(fits, horizon - 1, shock)
    both = curves.unionByName(responses.combined(curves).select(*curves.columns))
    name = scalars.lookup(F.col("model"), index_of or {}, default=F.col("model"))
    return both.select(name.alias("uncertainty"), "regime", "impulse", "response", "h", "value")


def scenario_run(specs: DataFrame, kernels: DataFrame, sigma: DataFrame | None = None, how: str = "residual") -> dict[str, DataFrame]:
    """All scenarios, their decomposition by variance shares, and the mass report.

    Kernels and paths are checkpointed: shares, deltas and contributions read them.
    """
    kernels = cut_lineage(kernels)
    tidy = cut_lineage(scenarios.run_scenarios(specs, kernels, sigma))
    variables = tidy.select("uncertainty", "variable").distinct()
    shares = S.shares_per_step(kernels, variables, ("combined", "low", "high"))
    base = contrib.extract_baseline(tidy, bounded=True)
    parts = contrib.decompose(contrib.extract_shocked(tidy), base, shares=shares, how=how)
    balance = contrib.mass_balance(parts["reconciled"], parts["delta"], include_residual=True)
    return {
        "paths": tidy, "shares": shares, **parts, "mass": contrib.mass_report(balance),
        "by_regime": contrib.by_regime(parts["delta"]), "energy": contrib.energy(parts["delta"]),
        "issues": checks.input_issues(base, contrib.extract_shocked(tidy)),
    }


def write(tables: Mapping[str, DataFrame], folder: str, overwrite: bool = True) -> None:
    """Every table of a stage as Parquet under ``folder``."""
    for name, df in tables.items():
        writers.save(df, f"{folder}/{name}", overwrite)


def wide_panel(panel_table: DataFrame, names: Sequence[str], value: str = "ret") -> DataFrame:
    return reshape.to_wide(panel_table, ["date"], "series_id", value, names)
