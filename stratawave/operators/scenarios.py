"""Shock scenarios as joins: inputs over time, convolution with response kernels,
bands over draws."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.functions.distributions import normal_quantile
from stratawave.functions.quantiles import exact_quantiles
from stratawave.operators import series as S
from stratawave.operators.joins import baseline_vs_shocked, salted_join
from stratawave.operators.reshape import complete_grid


# ------------------------------------------------------------- shock inputs


def input_grid(specs: DataFrame) -> DataFrame:
    """Inputs ``(scenario, horizon, t, impulse, u)`` of path scenarios.

    A schedule item adds its size on each step from t_start to t_end within 1..H; a
    shock adds at step 1.  If both hit the same step they add up.
    """
    item = F.col("s")
    start = F.greatest(F.lit(1), F.coalesce(item["t_start"], F.lit(1)))
    end = F.least(F.col("horizon"), F.coalesce(item["t_end"], start))
    scheduled = specs.select("name", "horizon", F.explode("schedule").alias("s")).where(
        item["impulse"].isNotNull() & (start <= end)
    ).select(
        "name", "horizon", item["impulse"].alias("impulse"), F.coalesce(item["size"], F.lit(1.0)).alias("size"),
        F.explode(F.sequence(start, end)).alias("t"),
    )
    once = specs.select("name", "horizon", F.explode("shocks").alias("impulse", "size")).withColumn("t", F.lit(1))
    return scheduled.unionByName(once).groupBy(F.col("name").alias("scenario"), "horizon", "t", "impulse").agg(
        F.sum("size").alias("u")
    )


def profile(horizon: int, start: Column, length: Column, kind: str = "constant", decay: float = 0.5,
            values: Sequence[float] | None = None, normalize: bool = False) -> Column:
    """Shock heights on steps 1..horizon as an array column, zero outside the profile.

    A profile that reaches past the horizon is cut, and ramp and sinus then run over
    the shortened length.
    """
    if kind == "custom":
        length = F.lit(len(values or ()))
    cut = F.least(length, F.lit(horizon) - start + 1) if kind != "custom" else length
    steps = F.sequence(F.lit(1), F.lit(horizon))
    heights = F.transform(steps, lambda t: F.when(
        (t >= start) & (t < start + cut), scalars.profile_value(kind, t - start, cut, decay, values)
    ).otherwise(0.0))
    if not normalize:
        return heights
    top = F.array_max(F.transform(heights, lambda v: F.abs(v)))
    return F.transform(heights, lambda v: F.when(top > 0, v / top).otherwise(v))


def shock_vector(impulses: DataFrame, variables: DataFrame, normalize: str = "sum1",
                 aliases: Mapping[str, str] | None = None, ignore_case: bool = False, unknown: str = "error") -> DataFrame:
    """Sizes per variable: ``(scenario, variable, size)``.

    ``impulses`` is ``(scenario, impulse, size, weight)``; a single impulse takes the size
    itself, a basket shares it by weight (``none``, ``sum1``/``l1`` or ``l2`` norm).
    Names that are no variables stop the query; with ``unknown="drop"`` their part of the
    basket is left out, and the others keep their own share of all weights.
    """
    named = resolve_names(impulses, variables, aliases, ignore_case, unknown)
    whole = W.partitionBy("scenario")
    w = F.coalesce("weight", F.lit(1.0))
    scale = {
        "none": F.lit(1.0),
        "sum1": F.sum(F.abs(w)).over(whole), "l1": F.sum(F.abs(w)).over(whole),
        "l2": F.sqrt(F.sum(w * w).over(whole)),
    }[normalize]
    single = F.count("*").over(whole) == 1
    return named.select(
        "scenario", "variable", F.when(single, F.col("size")).otherwise(F.col("size") * F.try_divide(w, scale)).alias("size")
    ).where(F.col("variable").isNotNull())


def resolve_names(impulses: DataFrame, variables: DataFrame, aliases: Mapping[str, str] | None = None,
                  ignore_case: bool = False, unknown: str = "error") -> DataFrame:
    """Impulse names to model variables through aliases and, if asked, without case.

    A name that is no variable stops the query, or has a null variable with ``unknown="drop"``.
    """
    name = scalars.lookup(F.col("impulse"), aliases or {}, default=F.col("impulse"))
    fold = F.lower if ignore_case else (lambda c: c)
    known = variables.select("variable", fold(F.col("variable")).alias("_key")).dropDuplicates(["_key"])
    joined = impulses.withColumn("_key", fold(name)).join(known, "_key", "left").drop("_key")
    if unknown == "drop":
        return joined
    stop = F.raise_error(F.concat(F.lit("no variable of the model: "), F.coalesce("impulse", F.lit("NULL"))))
    return joined.withColumn("variable", F.when(F.col("variable").isNull(), stop).otherwise(F.col("variable")))


def shock_vector_issues(impulses: DataFrame, variables: DataFrame, zero_tol: float = 1e-12) -> DataFrame:
    """Checks and statistics of shock vectors, one row per scenario.

    Duplicates, names that are no variables, variables left out, support, norms, all zero.
    """
    known = variables.select("variable").distinct().withColumn("_known", F.lit(True))
    per_name = impulses.groupBy("scenario", F.col("impulse").alias("variable")).agg(
        F.count("*").alias("_n"), F.sum("size").alias("size"), F.count_if(F.isnan("size") | F.col("size").isNull()).alias("_bad")
    ).join(known, "variable", "left")
    value = F.when(F.col("_known"), F.abs("size"))
    n_vars = variables.select("variable").distinct().agg(F.count("*").alias("n"))
    return per_name.groupBy("scenario").agg(
        F.count_if(F.col("_n") > 1).alias("n_duplicate"),
        F.count_if(F.col("_known").isNull()).alias("n_unknown"),
        F.count_if(F.col("_known")).alias("_k"),
        F.sum("_bad").alias("n_not_finite"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("l1"),
        F.sqrt(F.coalesce(F.sum(value * value), F.lit(0.0))).alias("l2"),
        F.coalesce(F.max(value), F.lit(0.0)).alias("max_abs"),
        F.count_if(value > zero_tol).alias("support_size"),
    ).withColumn("n_missing", n_vars.select("n").scalar() - F.col("_k")).withColumn(
        "all_zero", F.col("support_size") == 0
    ).drop("_k")


def full_shock_vector(impulses: DataFrame, variables: DataFrame, duplicates: str = "sum") -> DataFrame:
    """Every variable of every scenario, missing ones zero, duplicates summed or averaged.

    The variables of the model come as one array, so no join of all pairs is made.
    """
    merged = impulses.groupBy("scenario", F.col("impulse").alias("variable")).agg(
        (F.sum if duplicates == "sum" else F.avg)("size").alias("size")
    )
    names = variables.agg(F.array_sort(F.collect_set("variable")).alias("v")).select("v").scalar()
    grid = impulses.select("scenario").distinct().withColumn("variable", F.explode(names))
    return grid.join(merged, ["scenario", "variable"], "left").select(
        "scenario", "variable", F.coalesce("size", F.lit(0.0)).alias("size")
    )


def scale_by_sigma(sizes: DataFrame, sigma: DataFrame, scale: str = "sd", regime: str | None = None,
                   min_sigma: float = 1e-8, winsor: float = 0.0, cap_abs: float | None = None,
                   cap_sd: float | None = None) -> DataFrame:
    """Shock sizes in sigma units to absolute sizes.

    ``sigma`` is ``(variable, regime, sigma)``.  The regime asked for is used if the table
    has it, else combined, low, high in this order, for all variables alike.
    ``winsor`` bounds sigma by its quantiles over the variables, however many there are.  Sizes
    whose variable has no sigma stay, with null results.
    """
    if not 0 <= winsor < 0.5:
        raise ValueError("winsor must be in [0, 0.5)")
    order = [r for r in dict.fromkeys([regime, "combined", "low", "high"]) if r]
    rank = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("regime"))
    best = sigma.where(rank > 0).agg(F.min(rank).alias("b")).select("b").scalar()
    used = sigma.where(rank == best)
    value = F.col("sigma")
    if winsor > 0:
        stats = used.agg(
            F.percentile("sigma", F.lit(winsor)).alias("lo"), F.percentile("sigma", F.lit(1 - winsor)).alias("hi"),
        )
        lo, hi = stats.select("lo").scalar(), stats.select("hi").scalar()
        value = F.least(F.greatest(value, lo), hi)
    used = used.select("variable", F.col("regime").alias("sigma_regime"), F.greatest(value, F.lit(min_sigma)).alias("sigma_used"))
    joined = sizes.join(used, "variable", "left")
    units = F.col("size")
    if cap_sd is not None:
        units = F.signum("size") * F.least(F.abs("size"), F.lit(abs(cap_sd)))
    scaled = F.col("size") if scale == "abs" else units * F.col("sigma_used")
    joined = joined.withColumn("_raw", scaled)
    if cap_abs is None:
        return joined.withColumns({"scaled": F.col("_raw"), "capped": F.lit(False)}).drop("_raw")
    limit = F.lit(abs(cap_abs))
    over = F.abs("_raw") > limit
    return joined.withColumns({
        "scaled": F.when(over, F.signum("_raw") * limit).otherwise(F.col("_raw")), "capped": over
    }).drop("_raw")


# ------------------------------------------------------------------- paths


def convolve(inputs: DataFrame, kernels: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """Effect of the inputs: y_t = sum over impulses and lags of u_(t-h) k_h.

    ``inputs`` is ``(scenario, horizon, t, impulse, u)``; ``kernels`` has ``uncertainty,
    regime, impulse, response, h`` and one or more value columns.  One equi-join on the
    impulse and one sum.  A model has few impulses, so the join is salted by what else
    identifies a kernel.
    """
    joined = salted_join(kernels, inputs.where(F.col("u") != 0), ["impulse"], ["uncertainty", "regime", "response"])
    at = F.col("t") + F.col("h")
    return joined.where(at <= F.col("horizon")).groupBy(
        "uncertainty", "scenario", "regime", F.col("response").alias("variable"), at.alias("t")
    ).agg(*[F.sum(F.col("u") * F.col(v)).alias(v) for v in values])


def convolve_bands(inputs: DataFrame, kernels: DataFrame) -> DataFrame:
    """Center, low and high paths from kernels with ``value, value_lo, value_hi``."""
    return convolve(inputs, kernels, ("value", "value_lo", "value_hi"))


def response_scenarios(specs: DataFrame, kernels: DataFrame, sigma: DataFrame) -> DataFrame:
    """Impulse-response scenarios: the kernel of one impulse times the shock size.

    A spec may hold several sub-scenarios.  ``abs`` units are divided by the impulse's
    sigma ``(uncertainty, impulse, sigma)``.
    """
    sub = F.col("s")
    listed = F.when(F.coalesce(F.size("scenarios"), F.lit(0)) > 0, F.col("scenarios")).otherwise(
        F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("impulse"),
                         F.lit(None).cast("double").alias("size"), F.lit(None).cast("string").alias("units")))
    )
    runs = specs.withColumn("s", F.explode(listed)).select(
        F.coalesce(sub["name"], F.col("name")).alias("scenario"), "horizon", F.col("regime").alias("_want"),
        F.coalesce(sub["impulse"], F.col("impulse")).alias("impulse"),
        F.coalesce(F.try_element_at("shocks", F.coalesce(sub["impulse"], F.col("impulse"))),
                   sub["size"], F.col("size"), F.lit(1.0)).alias("_size"),
        F.lower(F.coalesce(sub["units"], F.col("units"), F.lit("sigma"))).alias("_units"),
    )
    joined = salted_join(kernels, runs, ["impulse"], ["uncertainty", "regime", "response"]).where(
        (F.col("_want").isin("all", "*") | (F.col("_want") == F.col("regime"))) & (F.col("h") < F.col("horizon"))
    ).join(sigma.select("uncertainty", "impulse", "sigma"), ["uncertainty", "impulse"], "left")
    per_sigma = F.when(F.col("_units") == "abs", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(1.0)).otherwise(1.0)
    return joined.select(
        "uncertainty", "scenario", "regime", F.col("response").alias("variable"), (F.col("h") + 1).alias("t"),
        (F.col("_size") / per_sigma * F.col("value")).alias("value"),
    )


def run_scenarios(specs: DataFrame, kernels: DataFrame, sigma: DataFrame | None = None) -> DataFrame:
    """All scenarios for all indices and regimes in one job, stacked with zero baseline rows.

    Every variable of the model gets a row on every step 1..H, zero where nothing
    reaches it.  ``all`` as regime runs every regime of the kernels.
    """
    paths = specs.where(F.col("type") != "girf")
    wanted = paths.select(F.col("name").alias("scenario"), "horizon", F.col("regime").alias("_want"))
    effects = convolve(input_grid(paths), kernels).join(wanted.drop("horizon"), "scenario").where(
        F.col("_want").isin("all", "*") | (F.col("_want") == F.col("regime"))
    ).drop("_want")
    # Every index and variable of a regime meets every scenario that asks for the regime:
    # that product is the result, so its join is salted over the models.
    axes = kernels.select("uncertainty", "regime", F.col("response").alias("variable")).distinct()
    asked = F.col("_want").isin("all", "*")
    regimes = F.when(asked, axes.agg(F.collect_set("regime").alias("r")).select("r").scalar()).otherwise(F.array("_want"))
    grid = salted_join(
        axes, wanted.select("scenario", "horizon", F.explode(regimes).alias("regime")), ["regime"], ["uncertainty", "variable"]
    ).withColumn("t", F.explode(F.sequence(F.lit(1), F.col("horizon"))))
    keys = ["uncertainty", "scenario", "regime", "variable", "t"]
    shocked = grid.join(effects, keys, "left").select(*keys, F.coalesce("value", F.lit(0.0)).alias("value"))
    if sigma is not None:
        shocked = shocked.unionByName(response_scenarios(specs.where(F.col("type") == "girf"), kernels, sigma).select(*keys, "value"))
    # Baseline rows ride along with the shocked ones, so the paths are computed once.
    halves = F.array(
        F.struct(F.lit(False).alias("is_baseline"), F.col("value").alias("value")),
        F.struct(F.lit(True).alias("is_baseline"), F.lit(0.0).alias("value")),
    )
    return shocked.select(*keys, F.inline(halves))


def baseline_paths(horizon: int, variables: DataFrame, method: str = "zero", innovations: DataFrame | None = None,
                   kernels: DataFrame | None = None) -> DataFrame:
    """Baseline ``(variable, t, value, is_baseline)``: zero, the conditional mean (column
    ``mu`` of ``variables``), or innovations ``(t, impulse, u)`` convolved with responses."""
    grid = variables.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    if method == "zero":
        out = grid.select("variable", "t", F.lit(0.0).alias("value"))
    elif method == "mean":
        out = grid.select("variable", "t", F.coalesce("mu", F.lit(0.0)).alias("value"))
    elif method == "innovations":
        inputs = innovations.where(F.col("t") <= horizon).select(
            F.lit("baseline").alias("scenario"), F.lit(horizon).alias("horizon"), "t", "impulse", "u"
        )
        named = kernels.withColumns({"uncertainty": F.lit("-"), "regime": F.lit("-")})
        effect = convolve(inputs, named).select("variable", "t", "value")
        out = grid.select("variable", "t").join(effect, ["variable", "t"], "left").select(
            "variable", "t", F.coalesce("value", F.lit(0.0)).alias("value")
        )
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.withColumn("is_baseline", F.lit(True))


def assemble(tidy: DataFrame, wide: bool = False, fill_grid: bool = False, compute_delta: bool = True) -> DataFrame:
    """Tidy rows with baseline, shocked and delta, or one wide row per key."""
    if fill_grid:
        tidy = complete_grid(tidy)
    joined = baseline_vs_shocked(tidy)
    if wide:
        return joined
    if not compute_delta:
        return tidy
    keys = [k for k in ("uncertainty", "scenario", "regime", "variable", "t") if k in tidy.columns]
    return tidy.join(joined, keys, "left")


def assembly_counts(tidy: DataFrame) -> DataFrame:
    """Counts and ranges of an assembled table, and rows that break its contract."""
    return tidy.agg(
        F.count("*").alias("n_rows"), F.count_distinct("scenario").alias("n_scenarios"),
        F.count_distinct("variable").alias("n_variables"), F.count_distinct("regime").alias("n_regimes"),
        F.min("t").alias("t_min"), F.max("t").alias("t_max"),
        F.count_if(F.col("t").isNull() | (F.col("t") < 1)).alias("n_bad_t"),
        F.count_if(F.col("is_baseline").isNull()).alias("n_bad_flag"),
    )


# ------------------------------------------------------------------- bands


def level_tag(level: float) -> str:
    return f"{100 * level:02.0f}"


def bands(tidy: DataFrame, levels: Sequence[float] = (0.90,), method: str = "percentile", center: str = "mean",
          keys: Sequence[str] = ("scenario", "variable", "regime", "t", "is_baseline"), value: str = "value",
          include_baseline: bool = False, keep_draws: bool = False) -> DataFrame:
    """Center and bands over draws.  Percentile bands use exact type-7 quantiles that
    never bring the draws of one key together."""
    keys = list(keys)
    names = [f"{side}_{level_tag(p)}" for p in levels for side in ("lo", "hi")]
    probs = [q for p in levels for q in ((1 - p) / 2, 1 - (1 - p) / 2)] if method == "percentile" else []
    want = list(zip(probs, names)) + ([(0.5, "_median")] if center == "median" else [])
    if want:
        out = exact_quantiles(tidy, keys, value, [p for p, _ in want], [n for _, n in want], moments=("_mean", "_sd"))
    else:
        out = tidy.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_sd"))
    if method == "normal":
        for p in levels:
            z = F.lit(normal_quantile((1 + p) / 2))
            out = out.withColumns({
                f"lo_{level_tag(p)}": F.col("_mean") - z * F.col("_sd"),
                f"hi_{level_tag(p)}": F.col("_mean") + z * F.col("_sd"),
            })
    mid = F.col("_median") if center == "median" else F.col("_mean")
    blank = F.col("is_baseline") if "is_baseline" in keys and not include_baseline else F.lit(False)
    out = out.select(*keys, mid.alias("value"), *[F.when(~blank, F.col(n)).alias(n) for n in names])
    if keep_draws:
        out = out.unionByName(tidy.withColumnRenamed(value, "value"), allowMissingColumns=True)
    return out


def draw_deltas(tidy: DataFrame, cumulative: bool = False, percent: bool = False, eps: float = 1e-8,
                keys: Sequence[str] = ("scenario", "variable", "regime")) -> DataFrame:
    """Shocked minus baseline per draw; optionally in percent, optionally summed over t.

    Both halves meet in one aggregation per (key, t, draw) instead of a self join.
    """
    keys = list(keys)
    base = F.max(F.when(F.col("is_baseline"), F.col("value")))
    shock = F.max(F.when(~F.col("is_baseline"), F.col("value")))
    both = tidy.groupBy(*keys, "t", "draw").agg(base.alias("_b"), shock.alias("_s")).where(
        F.col("_b").isNotNull() & F.col("_s").isNotNull()
    )
    delta = F.col("_s") - F.col("_b")
    out = both.select(*keys, "t", "draw", (100.0 * delta / (F.abs("_b") + eps) if percent else delta).alias("delta"))
    if cumulative:
        out = out.withColumn("delta", S.cumulative("delta", [*keys, "draw"]))
    return out


def delta_bands(tidy: DataFrame, levels: Sequence[float] = (0.90,), cumulative: bool = False,
                method: str = "percentile", center: str = "mean", **options) -> DataFrame:
    deltas = draw_deltas(tidy, cumulative, **options)
    return bands(deltas, levels, method, center, keys=["scenario", "variable", "regime", "t"], value="delta")


def extreme_points(delta: DataFrame, keys: Sequence[str] = ("scenario", "variable", "regime"), value: str = "value") -> DataFrame:
    """The point with the largest absolute value per curve, the first one on a tie."""
    best = F.min_by(F.struct("t", value), F.struct(-F.abs(value), F.col("t")))
    return delta.where(F.col(value).isNotNull()).groupBy(*keys).agg(best.alias("_p")).select(*keys, "_p.*")


def top_movers(tidy: DataFrame, n: int = 10) -> DataFrame:
    """Variables with the largest absolute value per scenario; ties with the last are kept."""
    size = tidy.where(~F.col("is_baseline")).groupBy("scenario", "variable").agg(F.max(F.abs("value")).alias("max_abs"))
    rank = F.rank().over(W.partitionBy("scenario").orderBy(F.col("max_abs").desc()))
    return size.withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def envelope(inputs: DataFrame, kernels: DataFrame, impact: DataFrame) -> DataFrame:
    """Response envelope of a scenario: impacts spread the shock over the variables, the
    band bounds swap where the impact is negative.

    ``inputs`` is ``(scenario, horizon, t, impulse, u)``, ``impact`` is ``(i, j, value)``
    (variable i moves by value per unit shock to j), ``kernels`` has the value columns.
    """
    spread = inputs.join(impact.select(F.col("j").alias("impulse"), F.col("i").alias("_i"), F.col("value").alias("_a")), "impulse")
    impacts = spread.groupBy("scenario", "horizon", "t", F.col("_i").alias("impulse")).agg(F.sum(F.col("u") * F.col("_a")).alias("u"))
    joined = salted_join(kernels, impacts.where(F.col("u") != 0), ["impulse"], ["uncertainty", "regime", "response"])
    at = F.col("t") + F.col("h")
    lo = F.when(F.col("u") >= 0, F.col("value_lo")).otherwise(F.col("value_hi"))
    hi = F.when(F.col("u") >= 0, F.col("value_hi")).otherwise(F.col("value_lo"))
    return joined.where(at <= F.col("horizon")).groupBy(
        "uncertainty", "scenario", "regime", F.col("response").alias("variable"), at.alias("t")
    ).agg(
        F.sum(F.col("u") * F.col("value")).alias("irf_center"),
        F.sum(F.col("u") * lo).alias("irf_lo"), F.sum(F.col("u") * hi).alias("irf_hi"),
    )


def overlay(delta: DataFrame, envelope_table: DataFrame) -> DataFrame:
    """Scenario deltas next to the envelope, for the variables the envelope has; before
    the first shock the envelope is zero."""
    keys = ["uncertainty", "scenario", "regime", "variable"]
    kept = delta.join(envelope_table.select(*keys).distinct(), keys, "left_semi")
    return kept.join(envelope_table, [*keys, "t"], "left").fillna(0.0, subset=["irf_center", "irf_lo", "irf_hi"])
