"""Queries on scenarios, decompositions and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratawave.operators import aggregate, checks, contrib, fit, responses, scenarios, scores, shares
from stratawave.plans import inputs as I
from stratawave.plans.registry import cte, query, sel
from stratawave.session import cut_lineage
from stratawave.sources.readers import read_table

KEYS = "uncertainty scenario regime variable t"
PATHS = "uncertainty, scenario, regime, variable"

# ------------------------------------------------------------- shock inputs


@query("input_grid", sel("scenario horizon t impulse", "u", "ugrid WHERE impulse IN (SELECT p_type FROM part)"))
def input_grid(spark, sf):
    """Schedules and one-off shocks of the specs, for the impulses the data has."""
    known = read_table(spark, sf, "part").select(F.col("p_type").alias("impulse")).distinct()
    return scenarios.input_grid(I.specs(spark).where(F.col("type") == "path")).join(known, "impulse", "left_semi")


def _shape_sql(kind: str) -> str:
    cut = "least(len, 12 - st + 1)"
    share = f"CASE WHEN {cut} > 1 THEN (t - st)::DOUBLE / ({cut} - 1) ELSE 0.0 END"
    return {"constant": "1.0::DOUBLE", "ramp": share, "expdecay": "power(0.7::DOUBLE, t - st)", "sinus": f"sin(({share}) * pi())"}[kind]

cte("prof", """SELECT * FROM (SELECT c_mktsegment, (1 + count(*) % 5)::INT AS st, (2 + count(DISTINCT c_nationkey) % 13)::INT AS len FROM customer GROUP BY 1) p, (SELECT unnest(range(1, 13)) AS t) u""")


@query("shock_profiles", "SELECT c_mktsegment, st AS start, kind, t::INT AS t, round(CASE WHEN t >= st AND t < st + least(len, 12 - st + 1) THEN v ELSE 0 END, 6) + 0.0 AS height FROM (" + " UNION ALL ".join(
    f"SELECT c_mktsegment, st, len, '{k}' AS kind, t, {_shape_sql(k)} AS v FROM prof" for k in ("constant", "ramp", "expdecay", "sinus")) + ") s")
def shock_profiles(spark, sf):
    """Four shapes whose start and length come from the customers of a segment."""
    seg = _segments(spark, sf)
    parts = [
        seg.select("c_mktsegment", "start", F.lit(k).alias("kind"), F.posexplode(
            scenarios.profile(12, F.col("start"), F.col("len"), k, decay=0.7)).alias("_p", "height"))
        for k in ("constant", "ramp", "expdecay", "sinus")
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("c_mktsegment", "start", "kind", (F.col("_p") + 1).alias("t"), "height")


def _segments(spark, sf):
    return read_table(spark, sf, "customer").groupBy("c_mktsegment").agg(
        (1 + F.count("*") % 5).cast("int").alias("start"), (2 + F.count_distinct("c_nationkey") % 13).cast("int").alias("len"))




@query("normalised_profiles", """
SELECT c_mktsegment, t::INT AS t, round(CASE WHEN t >= st AND t < st + 3 AND st + 2 <= 12 THEN (CASE t - st WHEN 0 THEN 0.5 WHEN 1 THEN -2.0 ELSE 1.0 END) / 2 ELSE 0 END, 6) + 0.0 AS height FROM prof""")
def normalised_profiles(spark, sf):
    """A given profile, scaled to a largest absolute height of one."""
    heights = scenarios.profile(12, F.col("start"), F.col("len"), "custom", values=[0.5, -2.0, 1.0], normalize=True)
    return _segments(spark, sf).select("c_mktsegment", F.posexplode(heights).alias("_p", "height")).select(
        "c_mktsegment", (F.col("_p") + 1).alias("t"), "height")


def _baskets(spark, sf):
    """One basket per nation of suppliers: part types of their lines as impulses."""
    lines = read_table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    per = lines.groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    typed = per.join(read_table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.sum("q").alias("q"))
    nation = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("scenario"))
    return typed.join(nation, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("scenario", F.lower("p_type").alias("impulse")).agg(
        F.lit(2.0).alias("size"), F.sum("q").alias("weight"))


cte("baskets", """
SELECT CAST(s_nationkey AS VARCHAR) AS scenario, lower(p_type) AS impulse, 2.0::DOUBLE AS size, sum(l_quantity) AS weight
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")


def _variables(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_type").alias("variable")).distinct()


@query("shock_vector_l1", """
SELECT scenario, upper(CASE impulse WHEN 'small' THEN 'large' ELSE impulse END) AS variable, round(size * weight / sum(weight) OVER (PARTITION BY scenario), 6) + 0.0 AS size FROM baskets""")
def shock_vector_l1(spark, sf):
    """Basket weights to sum one; names without case and an alias."""
    return scenarios.shock_vector(_baskets(spark, sf), _variables(spark, sf), "sum1", {"small": "large"}, ignore_case=True)


@query("shock_vector_l2", """
SELECT scenario, upper(impulse) AS variable, round(size * weight / sqrt(sum(weight * weight) OVER (PARTITION BY scenario)), 6) + 0.0 AS size FROM baskets""")
def shock_vector_l2(spark, sf):
    return scenarios.shock_vector(_baskets(spark, sf), _variables(spark, sf), "l2", ignore_case=True)


cte("dirty", """
SELECT scenario, upper(impulse) AS impulse, weight / 1000 AS size FROM baskets
UNION ALL SELECT scenario, 'SMALL', 0.5::DOUBLE FROM baskets WHERE impulse = 'promo' AND CAST(scenario AS INT) % 3 = 0
UNION ALL SELECT scenario, 'TITANIUM', 1.0::DOUBLE FROM baskets WHERE impulse = 'promo' AND CAST(scenario AS INT) % 4 = 0""")


def _dirty(spark, sf):
    base = _baskets(spark, sf).select("scenario", F.upper("impulse").alias("impulse"), (F.col("weight") / 1000).alias("size"))
    promo = base.where(F.col("impulse") == "PROMO").select("scenario")
    again = promo.where(F.col("scenario").cast("int") % 3 == 0).select("scenario", F.lit("SMALL").alias("impulse"), F.lit(0.5).alias("size"))
    odd = promo.where(F.col("scenario").cast("int") % 4 == 0).select("scenario", F.lit("TITANIUM").alias("impulse"), F.lit(1.0).alias("size"))
    return base.unionByName(again).unionByName(odd)


@query("shock_vector_issues", """
WITH n AS (SELECT scenario, impulse, count(*) AS c, sum(size) AS s FROM dirty GROUP BY 1, 2), k AS (SELECT *, impulse IN (SELECT p_type FROM part) AS known FROM n)
SELECT scenario, sum((c > 1)::INT)::BIGINT AS n_duplicate, sum((NOT known)::INT)::BIGINT AS n_unknown, 0::BIGINT AS n_not_finite, round(sum(CASE WHEN known THEN s ELSE 0 END), 6) + 0.0 AS l1,
  round(sqrt(sum(CASE WHEN known THEN s * s ELSE 0 END)), 6) + 0.0 AS l2, round(max(CASE WHEN known THEN s ELSE 0 END), 6) + 0.0 AS max_abs, sum((known AND s > 1e-12)::INT)::BIGINT AS support_size,
  (SELECT count(DISTINCT p_type) FROM part) - sum(known::INT)::BIGINT AS n_missing, sum((known AND s > 1e-12)::INT) = 0 AS all_zero FROM k GROUP BY 1""")
def shock_vector_issues(spark, sf):
    return scenarios.shock_vector_issues(_dirty(spark, sf), _variables(spark, sf))


@query("full_shock_vector", """
SELECT s.scenario, v.variable, round(coalesce(d.size, 0), 6) + 0.0 AS size FROM (SELECT DISTINCT scenario FROM dirty) s, (SELECT DISTINCT p_type AS variable FROM part) v
LEFT JOIN (SELECT scenario, impulse AS variable, avg(size) AS size FROM dirty GROUP BY 1, 2) d ON d.scenario = s.scenario AND d.variable = v.variable""")
def full_shock_vector(spark, sf):
    return scenarios.full_shock_vector(_dirty(spark, sf), _variables(spark, sf), "mean")


def _sigmas(spark, sf):
    """Return sd per brand and half of the year as the regimes."""
    from stratawave.operators import series

    ret = series.log_return(I.unit_prices(spark, sf, "p_brand"), out="ret").where(F.col("ret").isNotNull())
    return ret.groupBy(F.col("series").alias("variable"), F.when(F.month("date") <= 6, "low").otherwise("high").alias("regime")).agg(
        F.round(F.stddev_samp("ret"), 10).alias("sigma"))


@query("scaled_shocks", """
WITH s AS (SELECT series AS variable, round(stddev_samp(ret), 10) AS sigma FROM fret WHERE ret IS NOT NULL AND month(date) > 6 GROUP BY 1),
b AS (SELECT quantile_cont(sigma, 0.1) AS lo, quantile_cont(sigma, 0.9) AS hi FROM s), u AS (SELECT variable, least(greatest(sigma, lo, 1e-8), hi) AS su FROM s, b),
z AS (SELECT variable, CAST(regexp_extract(variable, '(\\d+)', 1) AS DOUBLE) - 12 AS size FROM s),
c AS (SELECT variable, size, su, sign(size) * least(abs(size), 8) * su AS raw FROM z JOIN u USING (variable))
SELECT variable, round(size, 6) + 0.0 AS size, 'high' AS sigma_regime, round(su, 6) + 0.0 AS sigma_used, round(CASE WHEN abs(raw) > 2 THEN sign(raw) * 2 ELSE raw END, 6) + 0.0 AS scaled, abs(raw) > 2 AS capped FROM c""")
def scaled_shocks(spark, sf):
    """Sizes in sd of the high regime, with winsorised sigma and both caps."""
    sigma = _sigmas(spark, sf)
    sizes = sigma.select("variable").distinct().withColumn("size", F.regexp_extract("variable", r"(\d+)", 1).cast("double") - 12)
    return scenarios.scale_by_sigma(sizes, sigma, "sd", "high", winsor=0.1, cap_abs=2.0, cap_sd=8.0)


# -------------------------------------------------------------------- paths


@query("response_kernels", sel("uncertainty regime impulse response h", "value", "kern"))
def response_kernels(spark, sf):
    return I.kernels(spark, sf)


@query("scenario_effects", "SELECT uncertainty, scenario, regime, variable, t::INT AS t, round(value, 8) + 0.0 AS value FROM effects", digits=8)
def scenario_effects(spark, sf):
    """Convolution of every path scenario with every kernel."""
    return scenarios.convolve(scenarios.input_grid(I.specs(spark).where(F.col("type") == "path")), I.kernels(spark, sf))


_BANDK = "(SELECT *, value - 0.25 * abs(value) AS value_lo, value + 0.5 * abs(value) AS value_hi FROM kern) k"


def _banded(spark, sf, kernel=None):
    return (kernel or I.kernels(spark, sf)).withColumns({"value_lo": F.col("value") - 0.25 * F.abs("value"), "value_hi": F.col("value") + 0.5 * F.abs("value")})


@query("scenario_effect_bands", f"""
SELECT uncertainty, scenario, regime, response AS variable, (t + h)::INT AS t, round(sum(u * value), 11) + 0.0 AS value, round(sum(u * value_lo), 11) + 0.0 AS value_lo,
  round(sum(u * value_hi), 11) + 0.0 AS value_hi FROM ugrid JOIN {_BANDK} USING (impulse) WHERE t + h <= horizon GROUP BY 1, 2, 3, 4, 5""", digits=11)
def scenario_effect_bands(spark, sf):
    grid = scenarios.input_grid(I.specs(spark).where(F.col("type") == "path"))
    return scenarios.convolve_bands(grid, _banded(spark, sf))


@query("response_scenarios", "SELECT uncertainty, scenario, regime, variable, t::INT AS t, round(value, 8) + 0.0 AS value FROM shocked WHERE scenario IN ('resp_small', 'pair_a', 'pair_b')", digits=8)
def response_scenarios(spark, sf):
    """Scenarios of one impulse, in sigma and in absolute units."""
    return scenarios.response_scenarios(I.specs(spark).where(F.col("type") == "girf"), I.kernels(spark, sf), I.shock_sigma(spark, sf))


@query("scenario_paths", "SELECT uncertainty, scenario, regime, variable, t::INT AS t, is_baseline, value FROM tidy", digits=8)
def scenario_paths(spark, sf):
    """All scenarios, indices and regimes with their baseline rows."""
    return I.tidy(spark, sf)


@query("baseline_means", """
SELECT s.variable, t::INT AS t, round(s.mu, 6) + 0.0 AS value, TRUE AS is_baseline FROM (SELECT series AS variable, avg(ret) AS mu FROM ret GROUP BY 1) s, (SELECT unnest(range(1, 7)) AS t) u""")
def baseline_means(spark, sf):
    mu = I.type_returns(spark, sf).groupBy(F.col("series").alias("variable")).agg(F.avg("ret").alias("mu"))
    return scenarios.baseline_paths(6, mu, "mean")


_INNOV = "(SELECT series AS impulse, t, round(ret, 4) AS u FROM (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY date) AS t FROM ret WHERE ret IS NOT NULL) r WHERE t <= 10) n"


@query("baseline_innovations", f"""
SELECT response AS variable, (t + h)::INT AS t, round(sum(u * value), 7) + 0.0 AS value, TRUE AS is_baseline FROM {_INNOV} JOIN kern USING (impulse)
WHERE uncertainty = 'vol' AND regime = 'low' AND t + h <= 10 GROUP BY 1, 2""", digits=7)
def baseline_innovations(spark, sf):
    """First ten returns as innovations through the low-regime responses."""
    from pyspark.sql import Window as W

    ret = I.type_returns(spark, sf).where(F.col("ret").isNotNull())
    first = ret.select(F.col("series").alias("impulse"), F.row_number().over(W.partitionBy("series").orderBy("date")).alias("t"), F.round("ret", 4).alias("u"))
    kernel = I.kernels(spark, sf).where((F.col("uncertainty") == "vol") & (F.col("regime") == "low"))
    return scenarios.baseline_paths(10, _variables(spark, sf), "innovations", first.where(F.col("t") <= 10), kernel)


@query("assembled_paths", "SELECT uncertainty, scenario, regime, variable, t::INT AS t, is_baseline, CASE WHEN is_baseline THEN 0.0 ELSE value END AS value, 0.0::DOUBLE AS baseline, value AS shocked, value AS delta FROM shocked, (VALUES (TRUE), (FALSE)) AS f(is_baseline)", digits=8)
def assembled_paths(spark, sf):
    return scenarios.assemble(I.tidy(spark, sf))


@query("assembly_counts", """SELECT count(*) AS n_rows, count(DISTINCT scenario) AS n_scenarios, count(DISTINCT variable) AS n_variables, count(DISTINCT regime) AS n_regimes,
min(t)::INT AS t_min, max(t)::INT AS t_max, 0::BIGINT AS n_bad_t, 0::BIGINT AS n_bad_flag FROM tidy""")
def assembly_counts(spark, sf):
    return scenarios.assembly_counts(I.tidy(spark, sf))


# -------------------------------------------------------------------- bands

_DRAWS = """(SELECT 'lines' AS scenario, p_type AS variable, l_returnflag AS regime, year(l_shipdate)::INT AS t, l_linestatus = 'O' AS is_baseline, l_extendedprice AS value
FROM lineitem JOIN part ON l_partkey = p_partkey) d"""


def _draws(spark, sf):
    """Every line is one draw of its type, flag and year."""
    lines = read_table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice")
    part = read_table(spark, sf, "part").select("p_partkey", "p_type")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("lines").alias("scenario"), F.col("p_type").alias("variable"), F.col("l_returnflag").alias("regime"),
        F.year("l_shipdate").alias("t"), (F.col("l_linestatus") == "O").alias("is_baseline"), F.col("l_extendedprice").alias("value"))


_BK = "scenario, variable, regime, t, is_baseline"


@query("draw_bands", f"""
SELECT {_BK}, round(quantile_cont(value, 0.5), 6) + 0.0 AS value, CASE WHEN NOT is_baseline THEN round(quantile_cont(value, 0.05), 6) + 0.0 END AS lo_90, CASE WHEN NOT is_baseline THEN round(quantile_cont(value, 0.95), 6) + 0.0 END AS hi_90,
  CASE WHEN NOT is_baseline THEN round(quantile_cont(value, 0.25), 6) + 0.0 END AS lo_50, CASE WHEN NOT is_baseline THEN round(quantile_cont(value, 0.75), 6) + 0.0 END AS hi_50 FROM {_DRAWS} GROUP BY {_BK}""")
def draw_bands(spark, sf):
    """Median and percentile bands at two levels; baseline rows keep no bands."""
    return scenarios.bands(_draws(spark, sf), [0.9, 0.5], center="median")


@query("draw_bands_normal", f"""
SELECT {_BK}, round(avg(value), 4) + 0.0 AS value, round(avg(value) - 1.6448536269514722 * stddev_samp(value), 4) + 0.0 AS lo_90, round(avg(value) + 1.6448536269514722 * stddev_samp(value), 4) + 0.0 AS hi_90
FROM {_DRAWS} GROUP BY {_BK}""", digits=4)
def draw_bands_normal(spark, sf):
    return scenarios.bands(_draws(spark, sf), [0.9], "normal", include_baseline=True)


cte("ddraw", """
SELECT p_type AS variable, l_returnflag AS regime, year(l_shipdate)::INT AS t, l_linenumber AS draw, round(avg(l_extendedprice), 4) AS base,
  round(avg(l_extendedprice * (1 - l_discount)), 4) AS shock FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4""")


def _paired_draws(spark, sf):
    """Mean price per type, flag, year and line number, before and after discount."""
    lines = read_table(spark, sf, "lineitem").select("l_partkey", "l_linenumber", "l_returnflag", F.year("l_shipdate").alias("t"), "l_extendedprice",
                                                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
    part = read_table(spark, sf, "part").select("p_partkey", "p_type")
    means = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_returnflag", "t", "l_linenumber").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("base"), F.round(F.avg("net"), 4).alias("shock"))
    halves = F.array(F.struct(F.lit(True).alias("is_baseline"), F.col("base").alias("value")), F.struct(F.lit(False).alias("is_baseline"), F.col("shock").alias("value")))
    return means.select(F.lit("discount").alias("scenario"), F.col("p_type").alias("variable"), F.col("l_returnflag").alias("regime"), "t",
                        F.col("l_linenumber").alias("draw"), F.inline(halves))


@query("draw_deltas_cumulative", """
SELECT 'discount' AS scenario, variable, regime, t, draw, round(sum(100.0 * (shock - base) / (abs(base) + 1e-8)) OVER (PARTITION BY variable, regime, draw ORDER BY t), 4) + 0.0 AS delta FROM ddraw""", digits=4)
def draw_deltas_cumulative(spark, sf):
    return scenarios.draw_deltas(_paired_draws(spark, sf), cumulative=True, percent=True)


@query("delta_bands", """
SELECT 'discount' AS scenario, variable, regime, t, round(avg(shock - base), 3) + 0.0 AS value, round(quantile_cont(shock - base, 0.05), 3) + 0.0 AS lo_90, round(quantile_cont(shock - base, 0.95), 3) + 0.0 AS hi_90 FROM ddraw GROUP BY 2, 3, 4""", digits=3)
def delta_bands(spark, sf):
    return scenarios.delta_bands(_paired_draws(spark, sf), [0.9])


@query("extreme_points", f"""
SELECT uncertainty, scenario, variable, regime, t::INT AS t, value FROM (SELECT *, row_number() OVER (PARTITION BY uncertainty, scenario, variable, regime ORDER BY abs(value) DESC, t) AS rn FROM shocked) s WHERE rn = 1""", digits=8)
def extreme_points(spark, sf):
    t = I.tidy(spark, sf).where(~F.col("is_baseline"))
    return scenarios.extreme_points(t, ["uncertainty", "scenario", "variable", "regime"])


@query("top_movers", """
SELECT scenario, variable, m AS max_abs FROM (SELECT *, rank() OVER (PARTITION BY scenario ORDER BY m DESC) AS rk FROM (SELECT scenario, variable, max(abs(value)) AS m FROM shocked GROUP BY 1, 2) a) b WHERE rk <= 3""", digits=8)
def top_movers(spark, sf):
    return scenarios.top_movers(I.tidy(spark, sf), 3)


@query("scenario_envelope", f"""
WITH a AS (SELECT response AS i, impulse AS j, a AS v FROM slopes), u AS (SELECT scenario, horizon, t, i AS impulse, sum(u * v) AS u FROM ugrid JOIN a ON a.j = impulse GROUP BY 1, 2, 3, 4),
e AS (SELECT uncertainty, scenario, regime, response AS variable, t + h AS t, sum(u * value) AS c, sum(u * CASE WHEN u >= 0 THEN value_lo ELSE value_hi END) AS lo, sum(u * CASE WHEN u >= 0 THEN value_hi ELSE value_lo END) AS hi
  FROM u JOIN {_BANDK} USING (impulse) WHERE t + h <= horizon GROUP BY 1, 2, 3, 4, 5)
SELECT d.uncertainty, d.scenario, d.regime, d.variable, d.t::INT AS t, round(d.delta, 8) + 0.0 AS delta, round(coalesce(c, 0), 8) + 0.0 AS irf_center,
  round(coalesce(lo, 0), 8) + 0.0 AS irf_lo, round(coalesce(hi, 0), 8) + 0.0 AS irf_hi
FROM delta d JOIN (SELECT DISTINCT uncertainty, scenario, regime, variable FROM e) k USING (uncertainty, scenario, regime, variable)
LEFT JOIN e ON e.uncertainty = d.uncertainty AND e.scenario = d.scenario AND e.regime = d.regime AND e.variable = d.variable AND e.t = d.t""", digits=8)
def scenario_envelope(spark, sf):
    """Scenario deltas beside the envelope of responses after contemporaneous spread."""
    cov = fit.covariances(I.type_vectors(spark, sf))
    names = F.array(*[F.lit(t) for t in I.TYPES])
    var = cov.where(F.col("i") == F.col("j")).select("j", F.col("value").alias("_v"))
    impact = cov.join(var, "j").select(F.get(names, "i").alias("i"), F.get(names, "j").alias("j"), (F.col("value") / F.col("_v")).alias("value"))
    grid = scenarios.input_grid(I.specs(spark).where(F.col("type") == "path"))
    k = I.kernels(spark, sf)
    env = scenarios.envelope(grid, _banded(spark, sf, k), impact)
    return scenarios.overlay(I.deltas(spark, sf, I.tidy(spark, sf, k)), env)


# ------------------------------------------------------------ decomposition


@query("baseline_extraction", f"""SELECT uncertainty, regime, variable, t::INT AS t, round(quantile_cont(b, 0.5), 12) + 0.0 AS value FROM (SELECT *, value / 4 AS b FROM shocked) s GROUP BY 1, 2, 3, 4""", digits=12)
def baseline_extraction(spark, sf):
    """Median over scenarios of baseline rows that differ."""
    t = I.tidy(spark, sf).where(~F.col("is_baseline")).withColumns({"value": F.col("value") / 4, "is_baseline": F.lit(True)})
    return contrib.extract_baseline(t, bounded=True)


@query("shocked_extraction", "SELECT uncertainty, scenario, regime, variable, t::INT AS t, value FROM shocked WHERE scenario IN ('econ_drop', 'late_promo') AND variable IN ('SMALL', 'LARGE')", digits=8)
def shocked_extraction(spark, sf):
    return contrib.extract_shocked(I.tidy(spark, sf), ["econ_drop", "late_promo"], ["SMALL", "LARGE"])


@query("scenario_deltas", "SELECT uncertainty, scenario, regime, variable, t::INT AS t, round(delta, 8) + 0.0 AS delta FROM delta", digits=8)
def scenario_deltas(spark, sf):
    return I.deltas(spark, sf)


# Single-shock paths: each impulse alone, one unit at the first step.
cte("single", "SELECT uncertainty, regime, impulse AS shock_id, response AS variable, h + 1 AS t, value AS delta FROM kern")
_MAP = [("econ_drop", "ECONOMY", -2.0), ("basket", "SMALL", 0.5), ("basket", "LARGE", 1.5), ("basket", "PROMO", -1.0), ("unused", "MEDIUM", 1.0)]
_map = ", ".join(f"('{s}', '{k}', {w}::DOUBLE)" for s, k, w in _MAP)


def _single(spark, sf, kernel=None):
    return (kernel or I.kernels(spark, sf)).select("uncertainty", "regime", F.col("impulse").alias("shock_id"), F.col("response").alias("variable"),
                                       (F.col("h") + 1).alias("t"), "value")


def _shock_map(spark):
    return spark.createDataFrame(_MAP, "scenario string, shock_id string, weight double")


@query("pathwise_contributions", f"""
SELECT uncertainty, scenario, shock_id, regime, variable, t::INT AS t, round(weight * (delta - 0.001), 7) + 0.0 AS contribution FROM single JOIN (VALUES {_map}) AS m(scenario, shock_id, weight) USING (shock_id)
WHERE scenario IN ('econ_drop')""", digits=7)
def pathwise_contributions(spark, sf):
    """Weighted single-shock deltas of the scenarios that occur."""
    k = I.kernels(spark, sf)
    single = _single(spark, sf, k)
    base = single.select("uncertainty", "regime", "variable", "t", F.lit(0.001).alias("value")).distinct()
    return contrib.by_shock_paths(single, base, _shock_map(spark), I.deltas(spark, sf, I.tidy(spark, sf, k)))


@query("share_contributions", sel("uncertainty scenario shock_id regime variable t", "contribution", "contrib", 9), digits=9)
def share_contributions(spark, sf):
    return I.contributions(spark, sf)


cte("partial", "SELECT uncertainty, scenario, shock_id, regime, variable, t, CASE WHEN shock_id = 'SMALL' THEN contribution * 0.5 ELSE contribution END AS contribution FROM contrib")
cte("psum", "SELECT p.*, d.delta FROM (SELECT uncertainty, scenario, regime, variable, t, sum(contribution) AS total FROM partial GROUP BY 1, 2, 3, 4, 5) p JOIN delta d USING (uncertainty, scenario, regime, variable, t)")


def _partial(spark, sf):
    """Deltas, and contributions that miss half of one shock."""
    delta, full = I.decomposition(spark, sf)
    half = F.when(F.col("shock_id") == "SMALL", F.col("contribution") * 0.5).otherwise(F.col("contribution"))
    return full.withColumn("contribution", half), delta


@query("reconciled_residual", """
SELECT uncertainty, scenario, regime, variable, t::INT AS t, shock_id, round(contribution, 10) + 0.0 AS contribution FROM partial
UNION ALL SELECT uncertainty, scenario, regime, variable, t::INT, 'residual', round(delta - total, 10) + 0.0 FROM psum WHERE abs(delta - total) > 1e-6""", digits=10)
def reconciled_residual(spark, sf):
    return contrib.reconcile(*_partial(spark, sf), "residual", tol=1e-6)


@query("reconciled_scaled", """
SELECT p.uncertainty, p.scenario, p.regime, p.variable, p.t::INT AS t, p.shock_id, round(CASE WHEN abs(total) > 1e-7 THEN contribution * delta / total ELSE contribution END, 5) + 0.0 AS contribution
FROM partial p JOIN psum USING (uncertainty, scenario, regime, variable, t)
UNION ALL SELECT uncertainty, scenario, regime, variable, t::INT, 'residual', round(delta, 5) + 0.0 FROM psum WHERE abs(total) <= 1e-7 AND abs(delta) > 1e-7""", digits=5)
def reconciled_scaled(spark, sf):
    return contrib.reconcile(*_partial(spark, sf), "scale", tol=1e-7)


@query("decomposition_summary", """
SELECT uncertainty, scenario, variable, shock_id, round(sum(contribution), 5) + 0.0 AS sum_contribution, round(sum(abs(contribution)), 5) + 0.0 AS l1_contribution, round(max(abs(contribution)), 5) + 0.0 AS max_abs_contribution
FROM (SELECT d.*, f.impulse AS shock_id, d.delta * f.fevd_share AS contribution FROM delta d JOIN fevd f ON f.uncertainty = d.uncertainty AND f.regime = d.regime AND f.response = d.variable AND f.t = d.t) c GROUP BY 1, 2, 3, 4""", digits=5)
def decomposition_summary(spark, sf):
    """Decomposition by variance shares from the tidy table to the summary per shock."""
    k = I.kernels(spark, sf)
    t = I.tidy(spark, sf, k)
    zero = t.where("is_baseline").select("uncertainty", "regime", "variable", "t", "value").distinct()
    return contrib.decompose(contrib.extract_shocked(t), zero, shares=I.shares(spark, sf, k), tol=1e-7)["summary"]


def _regime_sql(size: str) -> str:
    return f"""SELECT uncertainty, scenario, variable, regime, round(total, 8) + 0.0 AS total, round(CASE WHEN sum(total) OVER w > 0 THEN total / sum(total) OVER w ELSE 0 END, 8) + 0.0 AS share
FROM (SELECT uncertainty, scenario, variable, regime, sum({size}) AS total FROM delta GROUP BY 1, 2, 3, 4) s WINDOW w AS (PARTITION BY uncertainty, scenario, variable)"""


@query("effects_by_regime", _regime_sql("abs(delta)"), digits=8)
def effects_by_regime(spark, sf):
    return contrib.by_regime(I.deltas(spark, sf))


@query("effects_by_regime_signed", _regime_sql("delta"), digits=8)
def effects_by_regime_signed(spark, sf):
    return contrib.by_regime(I.deltas(spark, sf), "signed")


_SHAP = f"""SELECT uncertainty, scenario, shock_id, regime, variable, t::INT AS t, {{method}} AS method, round(weight * delta, 8) + 0.0 AS shapley{{perms}}
FROM single JOIN (VALUES {_map}) AS m(scenario, shock_id, weight) USING (shock_id)"""


def _unit_deltas(spark, sf):
    return _single(spark, sf).withColumnRenamed("value", "delta")


@query("shapley_exact", _SHAP.format(method="'exact'", perms=""), digits=8)
def shapley_exact(spark, sf):
    """Under superposition the value is weight times delta."""
    return contrib.shapley(_unit_deltas(spark, sf), _shock_map(spark))


@query("shapley_sampled", _SHAP.format(method="'sampled'", perms=", 64 AS perms_used"), digits=8)
def shapley_sampled(spark, sf):
    """Orders drawn by hash."""
    return contrib.shapley_sampled(_unit_deltas(spark, sf), _shock_map(spark), 64)


@query("mass_report", """
SELECT count(*) AS n_keys, sum((abs(delta - total) > 1e-6)::INT)::BIGINT AS n_violations, round(max(abs(delta - total)), 5) + 0.0 AS max_abs_residual, sum((abs(delta - total) > 1e-6)::INT) = 0 AS ok FROM psum""", digits=5)
def mass_report(spark, sf):
    return contrib.mass_report(contrib.mass_balance(*_partial(spark, sf), 1e-6))


@query("input_issues", """
WITH b AS (SELECT DISTINCT uncertainty, regime, variable, t, value FROM tidy WHERE is_baseline AND (regime <> 'high' OR t <= 6))
SELECT 'error' AS level, 'baseline' AS "where", 't not a whole non-negative number' AS what, count(*) FILTER (t IS NULL OR t < 0 OR t <> round(t)) AS n_bad FROM b
UNION ALL SELECT 'error', 'shocked', 't not a whole non-negative number', count(*) FILTER (t IS NULL OR t < 0 OR t <> round(t)) FROM shocked
UNION ALL SELECT 'error', 'baseline', 'duplicate rows', (SELECT count(*) FROM (SELECT uncertainty, regime, variable, t FROM b GROUP BY ALL HAVING count(*) > 1) d) UNION ALL SELECT 'error', 'shocked', 'duplicate rows', (SELECT count(*) FROM shocked WHERE scenario = 'econ_drop' AND variable = 'SMALL')
UNION ALL SELECT 'error', 'overlap', 'no common variables and regimes', (SELECT (count(*) = 0)::INT FROM b JOIN shocked USING (uncertainty, regime, variable))
UNION ALL SELECT 'error', 'alignment', 'different sets of t', (SELECT count(DISTINCT (uncertainty, regime, variable)) FROM shocked WHERE regime = 'high')""")
def input_issues(spark, sf):
    """Duplicated shocked rows, and a baseline that stops early in one regime."""
    t = I.tidy(spark, sf)
    base = t.where("is_baseline").select("uncertainty", "regime", "variable", "t", "value").distinct()
    base = base.where((F.col("regime") != "high") | (F.col("t") <= 6))
    shocked = contrib.extract_shocked(t)
    again = shocked.where((F.col("scenario") == "econ_drop") & (F.col("variable") == "SMALL"))
    return checks.input_issues(base, shocked.unionByName(again))


# ------------------------------------------------------------------ metrics


@query("energy_metrics", """
SELECT uncertainty, scenario, regime, variable, round(sum(delta * delta), 6) + 0.0 AS energy, round(sum(power(0.9::DOUBLE, t - 1) * abs(delta)), 6) + 0.0 AS persistence, round(max(abs(delta)), 6) + 0.0 AS peak_abs FROM delta GROUP BY 1, 2, 3, 4""")
def energy_metrics(spark, sf):
    return contrib.energy(I.deltas(spark, sf))


cte("peak", """SELECT uncertainty, scenario, regime, t, top FROM (SELECT *, row_number() OVER (PARTITION BY uncertainty, scenario, regime ORDER BY abs(delta) DESC, t) AS rn, abs(delta) AS top FROM (SELECT *, round(delta, 8) AS d FROM delta) s) r WHERE rn = 1""")


@query("peak_horizons", "SELECT uncertainty, scenario, regime, t::INT AS t_peak, round(top, 8) + 0.0 AS peak_abs FROM peak", digits=8)
def peak_horizons(spark, sf):
    return contrib.peak_horizons(I.deltas(spark, sf))


@query("dispersion_at_peak", """
SELECT uncertainty, scenario, regime, round(stddev_samp(a), 6) + 0.0 AS csd_abs, round(sum(CASE WHEN rn <= 3 THEN a END) / sum(a), 6) + 0.0 AS top3_share_abs FROM (
  SELECT d.uncertainty, d.scenario, d.regime, abs(delta) AS a, row_number() OVER (PARTITION BY d.uncertainty, d.scenario, d.regime ORDER BY abs(delta) DESC) AS rn FROM delta d JOIN peak USING (uncertainty, scenario, regime, t)) s GROUP BY 1, 2, 3""")
def dispersion_at_peak(spark, sf):
    return contrib.dispersion_at_peak(I.deltas(spark, sf))


def _conc(rows: str) -> str:
    return f"""SELECT uncertainty, scenario, regime, round(sum(s * s), 6) + 0.0 AS herfindahl, round(sum(CASE WHEN rn <= 3 THEN s END), 6) + 0.0 AS top3_share FROM (
  SELECT *, row_number() OVER (PARTITION BY uncertainty, scenario, regime ORDER BY s DESC) AS rn FROM (
    SELECT c.uncertainty, c.scenario, c.regime, CASE WHEN sum(abs(contribution)) OVER w > 0 THEN abs(contribution) / sum(abs(contribution)) OVER w ELSE 0 END AS s FROM {rows} WINDOW w AS (PARTITION BY c.uncertainty, c.scenario, c.regime)) a) b GROUP BY 1, 2, 3"""


@query("concentration_peak", _conc("contrib c JOIN peak p ON p.uncertainty = c.uncertainty AND p.scenario = c.scenario AND p.regime = c.regime AND p.t = c.t"))
def concentration_peak(spark, sf):
    delta, parts = I.decomposition(spark, sf)
    return contrib.concentration(parts, delta)


_LAST = "(SELECT * FROM contrib QUALIFY t = max(t) OVER (PARTITION BY uncertainty, scenario, regime))"


@query("concentration_terminal", _conc(f"{_LAST} c"))
def concentration_terminal(spark, sf):
    return contrib.concentration(I.contributions(spark, sf), at="terminal")


@query("index_agreement", f"""
WITH v AS (SELECT scenario, regime, shock_id, sum(CASE WHEN uncertainty = 'vol' THEN contribution ELSE 0 END) AS a, sum(CASE WHEN uncertainty = 'macro' THEN contribution ELSE 0 END) AS b
  FROM {_LAST} c GROUP BY 1, 2, 3),
r AS (SELECT scenario, regime, rank() OVER (PARTITION BY scenario, regime ORDER BY a) + (count(*) OVER (PARTITION BY scenario, regime, a) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY scenario, regime ORDER BY b) + (count(*) OVER (PARTITION BY scenario, regime, b) - 1) / 2.0 AS rb FROM v)
SELECT scenario, regime, 'macro~vol' AS pair, round(corr(ra, rb), 6) + 0.0 AS rho FROM r GROUP BY 1, 2""")
def index_agreement(spark, sf):
    """Rank correlation of the shock totals of two indices at the last step of each scenario."""
    return contrib.index_agreement(I.contributions(spark, sf), ["vol", "macro"], at="terminal")


# ------------------------------------------------------------ output tables

_shock_cols = ", ".join(f"round(max(CASE WHEN shock_id = '{t}' THEN contribution END), 9) + 0.0 AS \"{t}\"" for t in I.TYPES)


@query("contributions_wide", f"SELECT uncertainty, scenario, regime, variable, t::INT AS t, {_shock_cols} FROM contrib GROUP BY 1, 2, 3, 4, 5", digits=9)
def contributions_wide(spark, sf):
    return contrib.contributions_wide(I.contributions(spark, sf), I.TYPES)


@query("totals_by_shock", """
SELECT uncertainty, scenario, variable, shock_id, round(total, 9) + 0.0 AS total, round(l1, 9) + 0.0 AS l1, row_number() OVER (PARTITION BY uncertainty, scenario, variable ORDER BY abs(total) DESC, shock_id)::INT AS place
FROM (SELECT uncertainty, scenario, variable, shock_id, sum(contribution) AS total, sum(abs(contribution)) AS l1 FROM contrib GROUP BY 1, 2, 3, 4) s""", digits=9)
def totals_by_shock(spark, sf):
    return contrib.totals_by_shock(I.contributions(spark, sf))


_W3 = "uncertainty, scenario, variable"
cte("termc", f"""SELECT {_W3}, shock_id, sum(contribution) AS contribution FROM contrib JOIN (SELECT {_W3}, max(t) AS t FROM contrib GROUP BY 1, 2, 3) m USING ({_W3}, t) GROUP BY 1, 2, 3, 4""")


@query("terminal_top", f"SELECT {_W3}, shock_id, round(contribution, 9) + 0.0 AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY {_W3} ORDER BY abs(contribution) DESC, shock_id) AS rn FROM termc) s WHERE rn <= 3", digits=9)
def terminal_top(spark, sf):
    return contrib.terminal_top(I.contributions(spark, sf), 3)


cte("autot", f"""SELECT {_W3}, t FROM (SELECT *, row_number() OVER (PARTITION BY {_W3} ORDER BY l1 DESC, t) AS rn FROM (SELECT {_W3}, t, sum(abs(contribution)) AS l1 FROM contrib GROUP BY 1, 2, 3, 4) a) b WHERE rn = 1""")


@query("auto_horizon", f"SELECT {_W3}, t::INT AS t FROM autot")
def auto_horizon(spark, sf):
    return contrib.auto_horizon(I.contributions(spark, sf))


cte("wbars", f"""
WITH g AS (SELECT {_W3}, shock_id, sum(contribution) AS contribution FROM contrib JOIN autot USING ({_W3}, t) GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (PARTITION BY {_W3} ORDER BY abs(contribution) DESC, shock_id) AS rn FROM g)
SELECT {_W3}, shock_id, contribution FROM k WHERE rn <= 3 UNION ALL SELECT {_W3}, 'Other', sum(contribution) FROM k WHERE rn > 3 GROUP BY 1, 2, 3""")


@query("waterfall", f"""
WITH v AS (SELECT {_W3}, row_number() OVER (PARTITION BY uncertainty, scenario ORDER BY sum(abs(contribution)) DESC, variable) AS rn FROM wbars GROUP BY 1, 2, 3),
b AS (SELECT w.* FROM wbars w JOIN v USING ({_W3}) WHERE rn <= 4)
SELECT {_W3}, shock_id, round(contribution, 9) + 0.0 AS contribution, row_number() OVER p::INT AS id, round(coalesce(sum(contribution) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) + 0.0 AS y0,
  round(sum(contribution) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) + 0.0 AS y1 FROM b WINDOW p AS (PARTITION BY {_W3} ORDER BY contribution, shock_id)""".replace("row_number() OVER p::INT", "CAST(row_number() OVER p AS INT)"), digits=9)
def waterfall(spark, sf):
    return contrib.waterfall(I.contributions(spark, sf), top=3, top_variables=4)


@query("top_variables", """
SELECT uncertainty, scenario, variable, round(l1, 9) + 0.0 AS l1 FROM (SELECT *, row_number() OVER (PARTITION BY uncertainty, scenario ORDER BY l1 DESC, variable) AS rn FROM (SELECT uncertainty, scenario, variable, sum(abs(contribution)) AS l1 FROM contrib GROUP BY 1, 2, 3) a) b WHERE rn <= 2""", digits=9)
def top_variables(spark, sf):
    return contrib.top_variables_by_size(I.contributions(spark, sf), 2)


@query("stacked_contributions", f"""
WITH g AS (SELECT {_W3}, shock_id, t, sum(contribution) AS contribution FROM contrib GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT {_W3}, shock_id, row_number() OVER (PARTITION BY {_W3} ORDER BY sum(abs(contribution)) DESC, shock_id) AS rn FROM g GROUP BY 1, 2, 3, 4),
f AS (SELECT {_W3}, t, CASE WHEN rn <= 2 THEN shock_id ELSE 'Other' END AS shock_group, sum(contribution) AS contribution FROM g JOIN k USING ({_W3}, shock_id) GROUP BY 1, 2, 3, 4, 5)
SELECT {_W3}, t::INT AS t, shock_group, round(contribution, 9) + 0.0 AS contribution, round(sum(contribution) OVER (PARTITION BY {_W3}, t), 9) + 0.0 AS net FROM f""", digits=9)
def stacked_contributions(spark, sf):
    return contrib.stacked(I.contributions(spark, sf), 2)


@query("stacked_shares", """
WITH i AS (SELECT impulse FROM fevd GROUP BY 1 ORDER BY sum(fevd_share) DESC, impulse LIMIT 2),
r AS (SELECT uncertainty, regime, response FROM (SELECT uncertainty, regime, response, row_number() OVER (PARTITION BY uncertainty, regime ORDER BY round(sum(fevd_share), 6) DESC, response) AS rn FROM fevd GROUP BY 1, 2, 3) s WHERE rn <= 6)
SELECT uncertainty, regime, response, t::INT AS t, CASE WHEN impulse IN (SELECT impulse FROM i) THEN impulse ELSE 'Other' END AS impulse_group, round(sum(fevd_share), 6) + 0.0 AS share
FROM fevd JOIN r USING (uncertainty, regime, response) GROUP BY 1, 2, 3, 4, 5""")
def stacked_shares(spark, sf):
    return contrib.share_stack(I.shares(spark, sf), 2, 6)


@query("contributions_in_units", """
SELECT uncertainty, scenario, shock_id, regime, variable, t::INT AS t, round(contribution / 100, 7) + 0.0 AS contribution, round(contribution / 100 * f, 5) + 0.0 AS contribution_scaled, u AS unit FROM contrib,
(SELECT CASE WHEN m < 1e-4 THEN 1e6 WHEN m < 1e-2 THEN 1e4 WHEN m < 1 THEN 100 ELSE 1 END AS f, CASE WHEN m < 1e-4 THEN 'ppm' WHEN m < 1e-2 THEN 'bps' WHEN m < 1 THEN '%' ELSE '' END AS u FROM (SELECT max(abs(contribution)) / 100 AS m FROM contrib) x) y""", digits=7)
def contributions_in_units(spark, sf):
    small = I.contributions(spark, sf).withColumn("contribution", F.col("contribution") / 100)
    return contrib.with_units(small).withColumn("contribution_scaled", F.round("contribution_scaled", 5))


@query("peak_steps", "SELECT uncertainty, scenario, regime, variable, t::INT AS t_peak, round(abs(delta), 8) + 0.0 AS peak_abs FROM (SELECT *, row_number() OVER (PARTITION BY uncertainty, scenario, regime, variable ORDER BY abs(delta) DESC, t) AS rn FROM delta) s WHERE rn = 1", digits=8)
def peak_steps(spark, sf):
    return aggregate.peak_step(I.deltas(spark, sf), ["uncertainty", "scenario", "regime", "variable"])


# ------------------------------------------------------------------- scores


def _table_inputs(spark, sf):
    from stratawave.plans import queries_models as M

    fits = cut_lineage(M._split(spark, sf)[1])
    curves = responses.generalized(fits, M.H)
    half = responses.half_life_envelope(responses.generalized(fits, 36))
    groups = M._groups(spark)
    return (
        M._proxy_table(shares.group_shares(curves, groups.withColumnRenamed("response", "impulse")), ["horizon", "share"]),
        M._proxy_table(responses.group_medians(half, groups, "half_life"), ["half_life"]),
        M._proxy_table(responses.group_medians(responses.persistence(curves, M.H), groups, "PI"), ["PI"]),
    )


cte("phl", """SELECT split_part(model, ':', 2) AS pair, CASE WHEN model LIKE 'vol%' THEN 'vxo_vix' ELSE 'jln' END AS proxy, CASE WHEN response IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'A' ELSE 'B' END AS "group", quantile_cont(m, 0.5) AS half_life
FROM (SELECT model, response, quantile_cont(half_life, 0.5) AS m FROM hlife WHERE regime = 'high' GROUP BY 1, 2) s GROUP BY 1, 2, 3""")
cte("ppi", """SELECT split_part(model, ':', 2) AS pair, CASE WHEN model LIKE 'vol%' THEN 'vxo_vix' ELSE 'jln' END AS proxy, CASE WHEN response IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'A' ELSE 'B' END AS "group", quantile_cont(m, 0.5) AS pi
FROM (SELECT model, response, quantile_cont(pi, 0.5) AS m FROM (SELECT model, impulse, response, sum(abs(value)) AS pi FROM irf WHERE h <= 24 AND regime = 'high' GROUP BY 1, 2, 3) p GROUP BY 1, 2) s GROUP BY 1, 2, 3""")


def _dd(h: int) -> str:
    cell = lambda p, r: f"max(CASE WHEN proxy = '{p}' AND regime = '{r}' THEN share END)"
    return f"""SELECT pair, "group", {cell('vxo_vix', 'H')} - {cell('vxo_vix', 'L')} - {cell('jln', 'H')} + {cell('jln', 'L')} AS v FROM pshare WHERE horizon = {h} GROUP BY 1, 2"""


cte("wedge", f"""
SELECT a.pair, a."group", a.v AS dd12, b.v AS dd24, p.d AS dpi, h.d AS dhl FROM ({_dd(12)}) a JOIN ({_dd(24)}) b ON a.pair = b.pair AND a."group" = b."group"
LEFT JOIN (SELECT pair, "group", max(CASE WHEN proxy = 'vxo_vix' THEN pi END) - max(CASE WHEN proxy = 'jln' THEN pi END) AS d FROM ppi GROUP BY 1, 2) p ON p.pair = a.pair AND p."group" = a."group"
LEFT JOIN (SELECT pair, "group", max(CASE WHEN proxy = 'vxo_vix' THEN half_life END) - max(CASE WHEN proxy = 'jln' THEN half_life END) AS d FROM phl GROUP BY 1, 2) h ON h.pair = a.pair AND h."group" = a."group" """)
_STUDY = ["pair", "group"]


@query("index_wedges", sel("pair group", "dd12 dd24 dpi dhl", "wedge"))
def index_wedges(spark, sf):
    return scores.wedges(*_table_inputs(spark, sf), _STUDY)


def _selection(spark, sf):
    """Selection rows of the pair models, one window per proxy and pair."""
    from stratawave.plans import queries_models as M

    s = M.model_selection_summary(spark, sf)
    vol = F.col("model").startswith("vol")
    return s.select(
        F.when(F.col("model").contains("ECONOMY"), "1986-2025").when(F.col("model").contains("MEDIUM"), "1990-01 to 2025-06").otherwise("other").alias("window"),
        F.when(vol, "vxo_vix").otherwise("jln").alias("proxy"), "s_H", "lambda_max_L", "lambda_max_H", "lb_p_L", "lb_p_H", F.lit(1).alias("run_at"))


cte("dmark", """
WITH s AS (SELECT s.model LIKE 'vol%' AS vol, rl < 1 AND rh < 1 AS stable, pl >= 0.01 AND ph >= 0.01 AS white FROM sides s
  JOIN (SELECT model, min(CASE WHEN regime = 'low' THEN p END) AS pl, min(CASE WHEN regime = 'high' THEN p END) AS ph FROM lbox GROUP BY 1) l ON l.model = s.model),
f AS (SELECT vol, bool_and(stable) AS st, bool_and(white) AS wh FROM s GROUP BY 1)
SELECT CASE WHEN bool_or(st AND wh) THEN '✓' WHEN bool_or(st) THEN '△' ELSE '✗' END AS mark FROM f""")


@query("diagnostics_mark", "SELECT mark FROM dmark")
def diagnostics_mark(spark, sf):
    return scores.diagnostics_mark(_selection(spark, sf))


@query("robustness_marks", """
SELECT pair, "group", (SELECT mark FROM dmark) AS diagnostics, CASE WHEN dd12 IS NULL OR dd24 IS NULL THEN '△' WHEN sign(dd12) = sign(dd24) AND greatest(abs(dd12), abs(dd24)) >= 0.03 THEN '✓' WHEN greatest(abs(dd12), abs(dd24)) >= 0.01 THEN '△' ELSE '✗' END AS dd,
  CASE WHEN dd12 IS NULL OR dd24 IS NULL THEN '△' WHEN sign(dd12) <> sign(dd24) THEN '✗' WHEN abs(dd24 - dd12) / greatest(abs(dd12), 1e-6) <= 0.5 THEN '✓' ELSE '△' END AS horizon,
  CASE WHEN dpi IS NULL THEN '△' WHEN abs(dpi) >= 0.15 THEN '✓' WHEN abs(dpi) >= 0.05 THEN '△' ELSE '✗' END AS d_pi,
  CASE WHEN dhl IS NULL THEN '△' WHEN abs(dhl) >= 0.05 THEN '✓' WHEN abs(dhl) >= 0.02 THEN '△' ELSE '✗' END AS d_half_life,
  (SELECT CASE WHEN max(CASE WHEN model LIKE '%ECONOMY%' THEN s END) IS NULL THEN '–' WHEN abs(max(CASE WHEN model LIKE '%ECONOMY%' THEN s END) - max(CASE WHEN model LIKE '%MEDIUM%' THEN s END)) <= 0.02 THEN '✓'
     WHEN abs(max(CASE WHEN model LIKE '%ECONOMY%' THEN s END) - max(CASE WHEN model LIKE '%MEDIUM%' THEN s END)) <= 0.05 THEN '△' ELSE '✗' END FROM (SELECT model, nh / (nl + nh) AS s FROM sides WHERE model LIKE 'vol%') q) AS splice
FROM wedge""")
def robustness_marks(spark, sf):
    return scores.robustness(scores.wedges(*_table_inputs(spark, sf), _STUDY), cut_lineage(_selection(spark, sf)), _STUDY)


@query("run_info", """SELECT 'lines' AS key, CAST(count(*) AS VARCHAR) AS value FROM lineitem UNION ALL SELECT 'orders', CAST(count(*) AS VARCHAR) FROM orders""")
def run_info(spark, sf):
    """What a run read, as key and value rows."""
    rows = [read_table(spark, sf, n).agg(F.count("*").cast("string").alias("value")).select(F.lit(k).alias("key"), "value")
            for k, n in (("lines", "lineitem"), ("orders", "orders"))]
    return rows[0].unionByName(rows[1])
