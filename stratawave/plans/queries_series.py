"""Queries on ordered series and on regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratawave.operators import aggregate, checks, series, states
from stratawave.plans import inputs as I
from stratawave.plans.registry import query, sel
from stratawave.session import cut_lineage

BY_INDEX = 'PARTITION BY "index" ORDER BY date'


@query("returns_by_regime", """
SELECT r.series, s."index", CASE s.state WHEN 1 THEN 'low' ELSE 'high' END AS regime, count(*) AS n,
  round(avg(r.ret), 6) + 0.0 AS mean_ret, round(stddev_samp(r.ret), 6) + 0.0 AS sd_ret
FROM ret r JOIN states s USING (date) WHERE r.ret IS NOT NULL AND s.state IS NOT NULL GROUP BY 1, 2, 3""")
def returns_by_regime(spark, sf):
    """Flagship: lines to monthly panel, returns, smoothed and delayed index, states, moments."""
    path = I.states(spark, sf).where(F.col("state").isNotNull()).select("index", "date", "state")
    rows = I.type_returns(spark, sf).where(F.col("ret").isNotNull()).join(path, "date")
    return rows.groupBy("series", "index", states.state_label(F.col("state")).alias("regime")).agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd_ret")
    )


# ----------------------------------------------------------------- series


@query("log_returns", "SELECT series, date, round(ret, 6) + 0.0 AS log_return FROM fret")
def log_returns(spark, sf):
    return series.log_return(I.unit_prices(spark, sf, "p_brand")).select("series", "date", "log_return")


@query("percent_log_returns", "SELECT series, date, round(100 * ret, 6) + 0.0 AS ret FROM ret")
def percent_log_returns(spark, sf):
    return series.log_return(I.unit_prices(spark, sf), out="ret", scale=100.0).select("series", "date", "ret")


@query("panel_returns", sel("series date", "price ln_price ret", "ret"))
def panel_returns(spark, sf):
    return I.type_returns(spark, sf)


@query("volatility_abs", "SELECT series, date, round(abs(ret), 6) + 0.0 AS vol_proxy FROM ret")
def volatility_abs(spark, sf):
    return series.volatility_proxy(I.type_returns(spark, sf), "abs").select("series", "date", "vol_proxy")


@query("volatility_clipped", """
WITH v AS (SELECT series, date, round(round(ret, 9) * round(ret, 9), 12) AS x FROM fret)
SELECT series, date, round(least(x, (SELECT quantile_cont(x, 0.9) FROM v)), 6) + 0.0 AS vol_proxy FROM v WHERE x IS NOT NULL
UNION ALL SELECT series, date, NULL FROM v WHERE x IS NULL""")
def volatility_clipped(spark, sf):
    """Squared returns cut at a quantile of the whole panel."""
    returns = series.log_return(I.unit_prices(spark, sf, "p_brand"), out="ret").withColumn("ret", F.round("ret", 9))
    return series.volatility_proxy(returns, "squared", clip=0.9).select("series", "date", "vol_proxy")


@query("moving_average", sel("index date", "value ma", "smooth"))
def moving_average(spark, sf):
    return I.smoothed(spark, sf)


@query("moving_average_gaps", """
SELECT series, date, CASE WHEN count(price) OVER w = 4 THEN round(avg(price) OVER w, 8) + 0.0 END AS ma
FROM gappy WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""", digits=8)
def moving_average_gaps(spark, sf):
    return I.gappy_brands(spark, sf).select("series", "date", series.moving_average("price", 4, ["series"]).alias("ma"))


@query("exponential_average", """
WITH n AS (SELECT "index", date, value, row_number() OVER (PARTITION BY "index" ORDER BY date) AS rn FROM idx WHERE value IS NOT NULL),
walk AS (SELECT "index", 3::BIGINT AS rn, (SELECT avg(value) FROM n m WHERE m.rn <= 3 AND m."index" = n."index") AS ema FROM n WHERE rn = 3
  UNION ALL SELECT w."index", n.rn, w.ema + 0.5 * (n.value - w.ema) FROM walk w JOIN n ON n."index" = w."index" AND n.rn = w.rn + 1)
SELECT n."index", n.date, round(n.value, 6) + 0.0 AS value, round(w.ema, 6) + 0.0 AS ema FROM n LEFT JOIN walk w ON w."index" = n."index" AND w.rn = n.rn""")
def exponential_average(spark, sf):
    return series.exponential_average(I.indices(spark, sf).where(F.col("value").isNotNull()))


_INTERP = """
SELECT series, date, price, CASE WHEN price IS NOT NULL THEN price WHEN b_rn - a_rn - 1 <= 2 THEN a + (b - a) * (rn - a_rn) / (b_rn - a_rn) END AS filled FROM (
  SELECT *, last_value(price IGNORE NULLS) OVER w AS a, last_value(CASE WHEN price IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS a_rn,
    first_value(price IGNORE NULLS) OVER f AS b, first_value(CASE WHEN price IS NOT NULL THEN rn END IGNORE NULLS) OVER f AS b_rn
  FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS rn FROM gappy) g
  WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) s"""


@query("interpolate_gaps", f"SELECT series, date, round(filled, 8) + 0.0 AS filled FROM ({_INTERP}) i", digits=8)
def interpolate_gaps(spark, sf):
    return series.interpolate(I.gappy_brands(spark, sf), 2, ["series"], value="price").select("series", "date", "filled")


_SPANS = """SELECT * FROM (SELECT "index", date, value FROM idx WHERE NOT ("index" = 'macro' AND date < DATE '1996-05-01')) s"""


def _spans(spark, sf):
    ix = I.indices(spark, sf)
    return ix.where(~((F.col("index") == "macro") & (F.col("date") < "1996-05-01")))


@query("common_span", f"""
WITH s AS ({_SPANS}), b AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(date) AS lo, max(date) AS hi FROM s WHERE value IS NOT NULL GROUP BY "index") x)
SELECT "index", date, round(value, 6) + 0.0 AS value FROM s, b WHERE date >= lo AND date <= hi""")
def common_span(spark, sf):
    return series.common_span(_spans(spark, sf))


@query("z_scores", """SELECT "index", date, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) + 0.0 AS z FROM idx WINDOW w AS (PARTITION BY "index")""")
def z_scores(spark, sf):
    return I.indices(spark, sf).select("index", "date", series.zscore("value", ["index"]).alias("z"))


@query("scaled_timelines", f"""
SELECT "index", date, round(100 * value / first_value(value IGNORE NULLS) OVER (PARTITION BY "index" ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) + 0.0 AS base100,
  round((value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w), 6) + 0.0 AS unit FROM idx WINDOW w AS (PARTITION BY "index")""")
def scaled_timelines(spark, sf):
    return I.indices(spark, sf).select(
        "index", "date", series.index_to_100("value", ["index"]).alias("base100"), series.min_max("value", ["index"]).alias("unit"))


@query("delayed_driver", sel("index date", "x", "driver"))
def delayed_driver(spark, sf):
    return I.driver(spark, sf)


@query("cumulative_returns", "SELECT series, date, round(sum(ret) OVER (PARTITION BY series ORDER BY date), 6) + 0.0 AS total FROM ret WHERE ret IS NOT NULL")
def cumulative_returns(spark, sf):
    return I.type_returns(spark, sf).where(F.col("ret").isNotNull()).select(
        "series", "date", series.cumulative("ret", ["series"], "date").alias("total"))


@query("filled_states", f"""
SELECT "index", date, state, coalesce(last_value(state IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(state IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS filled FROM states WINDOW w AS ({BY_INDEX})""")
def filled_states(spark, sf):
    return I.states(spark, sf).select("index", "date", "state", series.fill_state("state", ["index"]).alias("filled"))


@query("clean_returns", """
WITH l AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, max(l_shipdate::DATE) AS date,
  arg_max(CASE WHEN l_returnflag = 'A' THEN p END, CASE WHEN l_returnflag = 'A' THEN l_shipdate END) AS a,
  arg_max(CASE WHEN l_returnflag = 'N' THEN p END, CASE WHEN l_returnflag = 'N' THEN l_shipdate END) AS n,
  arg_max(CASE WHEN l_returnflag = 'R' THEN p END, CASE WHEN l_returnflag = 'R' THEN l_shipdate END) AS r
  FROM (SELECT l_shipdate, l_returnflag, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY 1, 2) d GROUP BY 1),
r AS (SELECT date, ln(a / lag(a) OVER (ORDER BY m)) AS a, ln(n / lag(n) OVER (ORDER BY m)) AS n, ln(r / lag(r) OVER (ORDER BY m)) AS r FROM l),
c AS (SELECT * FROM r WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL)
SELECT date, round((a - avg(a) OVER ()) / stddev_samp(a) OVER (), 6) + 0.0 AS "A", round((n - avg(n) OVER ()) / stddev_samp(n) OVER (), 6) + 0.0 AS "N",
  round((r - avg(r) OVER ()) / stddev_samp(r) OVER (), 6) + 0.0 AS "R" FROM c""")
def clean_returns(spark, sf):
    """Daily price table to standardised monthly returns of the last values."""
    from stratawave.operators.reshape import to_wide
    from stratawave.sources.readers import read_table

    day = read_table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"), "l_returnflag").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("p"))
    flags = ["A", "N", "R"]
    return series.clean_returns(to_wide(day, ["date"], "l_returnflag", "p", flags), flags)


@query("prepare_indices", f"""
WITH s AS (SELECT "index", date, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS value FROM ({_SPANS}) x
  WINDOW w AS (PARTITION BY "index" ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
b AS (SELECT max(lo) AS lo, min(hi) AS hi FROM (SELECT min(date) AS lo, max(date) AS hi FROM s WHERE value IS NOT NULL GROUP BY "index") y),
c AS (SELECT "index", date, value FROM s, b WHERE date >= lo AND date <= hi)
SELECT "index", date, round((value - avg(value) OVER z) / stddev_samp(value) OVER z, 6) + 0.0 AS value FROM c WINDOW z AS (PARTITION BY "index")""")
def prepare_indices(spark, sf):
    return series.prepare_indices(_spans(spark, sf))


@query("spliced_index", """
SELECT 'spliced' AS "index", date, round(value, 6) + 0.0 AS value FROM idx WHERE ("index" = 'macro' AND date < DATE '1998-01-01') OR ("index" = 'vol' AND date >= DATE '1998-01-01')""")
def spliced_index(spark, sf):
    ix = I.indices(spark, sf)
    return series.splice(ix.where(F.col("index") == "macro"), ix.where(F.col("index") == "vol"), "1998-01-01", "spliced")


# ---------------------------------------------------------------- regimes


@query("regime_states", sel("index date state", "x theta", "states"))
def regime_states(spark, sf):
    return I.states(spark, sf)


@query("delayed_flags", f"""
SELECT f."index", date, round(x, 6) + 0.0 AS x, (x > theta)::INT AS high FROM (
  SELECT "index", date, CASE WHEN "index" = 'vol' THEN lag(ma, 2) OVER w ELSE lag(ma, 1) OVER w END AS x FROM smooth WINDOW w AS ({BY_INDEX})) f
JOIN theta USING ("index")""")
def delayed_flags(spark, sf):
    """High flags with a delay of its own per index."""
    spec = I.thresholds(spark, sf).withColumn("d", F.when(F.col("index") == "vol", 2).otherwise(1))
    return states.delayed_flags(I.smoothed(spark, sf), spec, "d", value="ma")


_HYST = f"""
SELECT "index", date, last_value(signal IGNORE NULLS) OVER ({BY_INDEX} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM (
  SELECT "index", date, CASE WHEN row_number() OVER w = 1 THEN CASE WHEN ma IS NULL OR ma <= theta THEN 1 ELSE 2 END
      WHEN ma > theta + 0.4 * sd THEN 2 WHEN ma < theta - 0.4 * sd THEN 1 END AS signal
  FROM (SELECT s.*, t.theta, stddev_samp(ma) OVER (PARTITION BY s."index") AS sd FROM smooth s JOIN theta t ON t."index" = s."index") q WINDOW w AS ({BY_INDEX})) x"""


@query("hysteresis_states", f"SELECT * FROM ({_HYST}) h")
def hysteresis_states(spark, sf):
    rows = I.smoothed(spark, sf).join(I.thresholds(spark, sf), "index")
    return states.hysteresis(rows, F.col("theta"), 0.4, value="ma").select("index", "date", "state")


_RUNS = f"""
SELECT "index", run, any_value(state) AS state, min(idx) AS start_idx, max(idx) AS end_idx, min(date) AS start_date, max(date) AS end_date, count(*) AS duration FROM (
  SELECT *, sum(st) OVER ({BY_INDEX}) AS run FROM (
    SELECT *, row_number() OVER w AS idx, CASE WHEN state IS NOT NULL AND (lag(state) OVER w IS NULL OR lag(state) OVER w <> state) THEN 1 ELSE 0 END AS st
    FROM {{src}} WINDOW w AS ({BY_INDEX})) a) b WHERE state IS NOT NULL GROUP BY 1, 2"""
# States with holes: every 17th month is unknown.
_HOLES = "(SELECT \"index\", date, CASE WHEN (year(date) * 12 + month(date)) % 17 <> 0 THEN state END AS state FROM states)"


def _holes(spark, sf):
    return I.states(spark, sf).withColumn(
        "state", F.when((F.year("date") * 12 + F.month("date")) % 17 != 0, F.col("state"))).select("index", "date", "state")


_SPELL_COLS = """row_number() OVER (PARTITION BY "index" ORDER BY start_idx)::INT AS spell_id, CASE state WHEN 1 THEN 'low' ELSE 'high' END AS regime,
  start_idx::INT AS start_idx, end_idx::INT AS end_idx, start_date, end_date, duration::INT AS duration"""


@query("regime_spells", f"SELECT \"index\", {_SPELL_COLS} FROM ({_RUNS.format(src=_HOLES)}) r")
def regime_spells(spark, sf):
    return states.spells(_holes(spark, sf))


_MERGED = f"""
SELECT "index", g, arg_min(state, run) AS state, min(start_idx) AS start_idx, max(end_idx) AS end_idx, min(start_date) AS start_date,
  max(end_date) AS end_date, sum(duration) AS duration FROM (
  SELECT *, sum(kept) OVER (PARTITION BY "index" ORDER BY run) AS g FROM (
    SELECT *, CASE WHEN lag(end_idx) OVER w IS NULL OR lag(end_idx) OVER w + 1 <> start_idx OR duration >= 3 THEN 1 ELSE 0 END AS kept
    FROM ({_RUNS.format(src=_HOLES)}) r WINDOW w AS (PARTITION BY "index" ORDER BY run)) k) m GROUP BY 1, 2"""


@query("regime_spells_merged", f"SELECT \"index\", {_SPELL_COLS} FROM ({_MERGED}) r")
def regime_spells_merged(spark, sf):
    """Spells shorter than three months join the last kept spell."""
    return states.spells(_holes(spark, sf), min_spell=3)


@query("spell_ids", f"""
SELECT h."index", h.date, h.state, CASE WHEN h.state IS NOT NULL THEN s.spell_id END AS spell_id
FROM {_HOLES} h LEFT JOIN (SELECT "index", {_SPELL_COLS} FROM ({_RUNS.format(src=_HOLES)}) r) s
ON s."index" = h."index" AND h.date BETWEEN s.start_date AND s.end_date""")
def spell_ids(spark, sf):
    path = _holes(spark, sf)
    return states.spell_ids(path, states.spells(path))


@query("smoothed_states", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY "index" ORDER BY run) AS i, count(*) OVER (PARTITION BY "index") AS n,
    lead(state) OVER w AS rs, lead(duration) OVER w AS rl, lag(duration) OVER w AS ll
  FROM ({_RUNS.format(src='states')}) q WINDOW w AS (PARTITION BY "index" ORDER BY run)),
walk AS (SELECT "index", i, CASE WHEN duration >= 3 OR n = 1 THEN state ELSE rs END AS s FROM r WHERE i = 1
  UNION ALL SELECT r."index", r.i, CASE WHEN r.duration >= 3 THEN r.state WHEN r.i = r.n THEN walk.s WHEN r.rl >= r.ll THEN r.rs ELSE walk.s END
  FROM walk JOIN r ON r."index" = walk."index" AND r.i = walk.i + 1)
SELECT s."index", s.date, w.s AS state FROM states s LEFT JOIN r ON r."index" = s."index" AND s.date BETWEEN r.start_date AND r.end_date
LEFT JOIN walk w ON w."index" = r."index" AND w.i = r.i""")
def smoothed_states(spark, sf):
    """Spells shorter than three months take the state of a neighbour, left to right."""
    path = I.states(spark, sf).select("index", "date", "state")
    return states.smooth_short_spells(path, 3).select("index", "date", "state")


@query("spell_summary", f"""
SELECT "index", regime, count(*) AS n_spells, round(avg(duration), 6) + 0.0 AS mean_duration, round(quantile_cont(duration::DOUBLE, 0.5), 6) + 0.0 AS median_duration,
  round(stddev_samp(duration), 6) + 0.0 AS sd_duration, min(duration) AS min_duration, max(duration) AS max_duration,
  round(sum(duration) / (sum(sum(duration)) OVER (PARTITION BY "index")), 6) + 0.0 AS time_share
FROM (SELECT "index", {_SPELL_COLS} FROM ({_RUNS.format(src=_HOLES)}) r) s GROUP BY 1, 2""")
def spell_summary(spark, sf):
    return states.spell_summary(states.spells(_holes(spark, sf)))


_COUNTS = f"""SELECT "index", sum((state = 1 AND nxt = 1)::INT)::DOUBLE AS n11, sum((state = 1 AND nxt = 2)::INT)::DOUBLE AS n12, sum((state = 2 AND nxt = 1)::INT)::DOUBLE AS n21,
  sum((state = 2 AND nxt = 2)::INT)::DOUBLE AS n22 FROM (SELECT "index", state, lead(state) OVER ({BY_INDEX}) AS nxt FROM {{src}}) p WHERE state IS NOT NULL AND nxt IS NOT NULL GROUP BY 1"""
_PROBS = "SELECT *, n11/(n11+n12) AS p11, n12/(n11+n12) AS p12, n21/(n21+n22) AS p21, n22/(n21+n22) AS p22 FROM ({c}) c"
_P = _PROBS.format(c=_COUNTS.format(src=_HOLES))


@query("transition_matrix", f"""
SELECT "index", unnest(['low', 'low', 'high', 'high']) AS "from", unnest(['low', 'high', 'low', 'high']) AS "to", unnest([n11, n12, n21, n22]) AS n,
  unnest([round(p11, 6) + 0.0, round(p12, 6) + 0.0, round(p21, 6) + 0.0, round(p22, 6) + 0.0]) AS p FROM ({_P}) q""")
def transition_matrix(spark, sf):
    return states.tidy_transitions(states.transition_probs(states.transition_counts(_holes(spark, sf))))


@query("transition_rebuilt", f"""
SELECT "index", round((n11 + 1) / (n11 + n12 + 2), 6) + 0.0 AS p11, round((n12 + 1) / (n11 + n12 + 2), 6) + 0.0 AS p12,
  round((n21 + 1) / (n21 + n22 + 2), 6) + 0.0 AS p21, round((n22 + 1) / (n21 + n22 + 2), 6) + 0.0 AS p22
FROM ({_COUNTS.format(src=f"(SELECT * FROM {_HOLES} WHERE state IS NOT NULL)")}) c""")
def transition_rebuilt(spark, sf):
    """Unknown months removed before pairing, one added to each cell, rows renormalised,
    written as tidy rows and read back."""
    counts = states.transition_counts(_holes(spark, sf), add=1.0, skip_null_rows=True)
    probs = states.renormalize(states.transition_probs(counts, empty_row=0.5))
    return states.from_tidy_transitions(states.tidy_transitions(probs))


@query("persistence_interval", f"""
WITH q AS (SELECT "index", unnest(['p11', 'p22']) AS param, unnest([p11, p22]) AS p, unnest([n11 + n12, n21 + n22]) AS n FROM ({_P}) x),
e AS (SELECT *, sqrt(p * (1 - p) / n) AS se FROM q)
SELECT "index", param, round(p, 6) + 0.0 AS p, n, round(se, 6) + 0.0 AS se, round(greatest(0, p - 1.959963984540054 * se), 6) + 0.0 AS lo,
  round(least(1, p + 1.959963984540054 * se), 6) + 0.0 AS hi FROM e""")
def persistence_interval(spark, sf):
    return states.persistence_interval(states.transition_probs(states.transition_counts(_holes(spark, sf))))


@query("interval_midpoints", f"""
WITH q AS (SELECT "index", unnest(['p11', 'p22']) AS param, unnest([p11, p22]) AS p, unnest([n11 + n12, n21 + n22]) AS n FROM ({_P}) x),
b AS (SELECT "index", param, greatest(0, p - 1.959963984540054 * sqrt(p * (1 - p) / n)) AS lo, least(1, p + 1.959963984540054 * sqrt(p * (1 - p) / n)) AS hi FROM q)
SELECT "index", param, round((lo + hi) / 2, 6) + 0.0 AS mid, round(lo, 6) + 0.0 AS lo, round(hi, 6) + 0.0 AS hi FROM b""")
def interval_midpoints(spark, sf):
    return states.interval_midpoints(persistence_interval(spark, sf))


@query("chain_summary", f"""
SELECT "index", round(p21 / (p12 + p21), 6) + 0.0 AS pi_low, round(p12 / (p12 + p21), 6) + 0.0 AS pi_high, round(1 / (1 - p11), 6) + 0.0 AS expected_low,
  round(1 / (1 - p22), 6) + 0.0 AS expected_high, round(ln(0.5) / ln(p11), 6) + 0.0 AS half_life_low, round(ln(0.5) / ln(p22), 6) + 0.0 AS half_life_high,
  round(abs(p11 + p22 - 1), 6) + 0.0 AS lambda2, p11 > 0 AND p12 > 0 AND p21 > 0 AND p22 > 0 AS ergodic,
  abs(p21 / (p12 + p21) * p12 - p12 / (p12 + p21) * p21) < 1e-9 AS reversible FROM ({_P}) q""")
def chain_summary(spark, sf):
    out = states.chain_summary(states.transition_probs(states.transition_counts(_holes(spark, sf))))
    return out.drop("n11", "n12", "n21", "n22", "p11", "p12", "p21", "p22")


@query("implied_durations", f"""
SELECT "index", round(p11, 6) + 0.0 AS p11, round(p22, 6) + 0.0 AS p22, round(1 / (1 - p11), 6) + 0.0 AS implied_low, round(1 / (1 - p22), 6) + 0.0 AS implied_high,
  round(p11 + p22, 6) + 0.0 AS persistence FROM ({_P}) q""")
def implied_durations(spark, sf):
    return states.implied_durations(states.transition_probs(states.transition_counts(_holes(spark, sf))))


@query("transition_bootstrap")
def transition_bootstrap(spark, sf):
    """Block bootstrap of the persistence probabilities, block length from the spells."""
    path = cut_lineage(_holes(spark, sf))
    return states.bootstrap_transitions(path, states.block_length(states.spells(path)), draws=500)


@query("block_length", f"""
SELECT "index", greatest(2, round_even(quantile_cont(duration::DOUBLE, 0.5), 0))::INT AS block_len FROM ({_RUNS.format(src=_HOLES)}) r GROUP BY 1""")
def block_length(spark, sf):
    return states.block_length(states.spells(_holes(spark, sf)))


@query("regime_statistics", f"""
WITH n AS (SELECT "index", sum((state = 1)::INT)::BIGINT AS n_low, sum((state = 2)::INT)::BIGINT AS n_high FROM {_HOLES} h GROUP BY 1),
s AS (SELECT "index", count(*) FILTER (state = 1) AS n_spells_low, count(*) FILTER (state = 2) AS n_spells_high,
  quantile_cont(duration::DOUBLE, 0.5) FILTER (state = 1) AS ml, quantile_cont(duration::DOUBLE, 0.5) FILTER (state = 2) AS mh,
  max(duration) FILTER (state = 1)::INT AS max_duration_low, max(duration) FILTER (state = 2)::INT AS max_duration_high FROM ({_RUNS.format(src=_HOLES)}) r GROUP BY 1),
q AS ({_P})
SELECT n."index", n_low, n_high, round(n_low / (n_low + n_high), 6) + 0.0 AS share_low, round(n_high / (n_low + n_high), 6) + 0.0 AS share_high,
  NULL::DOUBLE AS rho_low, NULL::DOUBLE AS rho_high, n_spells_low, n_spells_high, round(ml, 6) + 0.0 AS median_duration_low, round(mh, 6) + 0.0 AS median_duration_high,
  max_duration_low, max_duration_high, round(p11, 6) + 0.0 AS p11, round(p12, 6) + 0.0 AS p12, round(p21, 6) + 0.0 AS p21, round(p22, 6) + 0.0 AS p22,
  round(p21 / (p12 + p21), 6) + 0.0 AS pi_low, round(p12 / (p12 + p21), 6) + 0.0 AS pi_high, round(1 / (1 - p11), 6) + 0.0 AS expected_low, round(1 / (1 - p22), 6) + 0.0 AS expected_high,
  CASE WHEN abs(p11 + p22 - 1) > 0 AND abs(p11 + p22 - 1) < 1 THEN round(ln(0.5) / ln(abs(p11 + p22 - 1)), 6) + 0.0 END AS half_life_lambda2,
  CASE WHEN abs(p11 + p22 - 1) > 0 AND abs(p11 + p22 - 1) < 1 THEN round(1 - abs(p11 + p22 - 1), 6) + 0.0 END AS mixing_rate, p11 > 0 AND p12 > 0 AND p21 > 0 AND p22 > 0 AS ergodic,
  round(n_low / (n_low + n_high) - p21 / (p12 + p21), 6) + 0.0 AS delta_pi_low, round(n_high / (n_low + n_high) - p12 / (p12 + p21), 6) + 0.0 AS delta_pi_high,
  p11 > 0.98 AS near_absorbing_low, p22 > 0.98 AS near_absorbing_high
FROM n JOIN s USING ("index") JOIN q USING ("index")""")
def regime_statistics(spark, sf):
    path = cut_lineage(_holes(spark, sf))
    probs = states.transition_probs(states.transition_counts(path))
    return states.regime_statistics(path, states.spells(path), probs)


@query("overlay_intervals", f"""SELECT "index", date AS xmin, coalesce(lead(date) OVER ({BY_INDEX}), date) AS xmax FROM states WHERE state = 2""")
def overlay_intervals(spark, sf):
    return states.overlay_intervals(I.states(spark, sf))


@query("duration_histogram", f"""
WITH s AS (SELECT "index", {_SPELL_COLS} FROM ({_RUNS.format(src=_HOLES)}) r), b AS (SELECT "index", min(duration) AS lo, max(duration) AS hi FROM s GROUP BY 1)
SELECT "index", regime, CASE WHEN hi > lo THEN ceil((duration - lo) / ((hi - lo) / 19.0::DOUBLE) + 0.5 - 1e-9)::INT ELSE 1 END AS bin, count(*) AS n FROM s JOIN b USING ("index") GROUP BY 1, 2, 3""")
def duration_histogram(spark, sf):
    return states.duration_histogram(states.spells(_holes(spark, sf)))


_HIGH = '(SELECT "index", date, CASE WHEN state IS NOT NULL THEN state - 1 END AS high FROM states)'


def _flags(spark, sf):
    return I.states(spark, sf).select("index", "date", (F.col("state") - 1).alias("high"))


@query("flag_overlap", f"""
SELECT sum((a.high = 1 AND b.high = 1)::INT)::BIGINT AS both_high, sum((a.high = 1 OR b.high = 1)::INT)::BIGINT AS any_high,
  round(sum((a.high = 1 AND b.high = 1)::INT) / sum((a.high = 1 OR b.high = 1)::INT), 6) + 0.0 AS jaccard
FROM {_HIGH} a JOIN {_HIGH} b ON a.date = b.date AND a."index" = 'vol' AND b."index" = 'macro'""")
def flag_overlap(spark, sf):
    return aggregate.flag_overlap(_flags(spark, sf), "vol", "macro")


@query("high_share", f'SELECT "index", count(high) AS n, round(avg(high), 6) + 0.0 AS s_high FROM {_HIGH} h WHERE high IS NOT NULL GROUP BY 1')
def high_share(spark, sf):
    return aggregate.high_share(_flags(spark, sf))


@query("share_gap", f"""SELECT round(a, 6) + 0.0 AS s_a, round(b, 6) + 0.0 AS s_b, round(a - b, 6) + 0.0 AS gap FROM (
  SELECT avg(CASE WHEN "index" = 'vol' THEN high END) AS a, avg(CASE WHEN "index" = 'macro' THEN high END) AS b FROM {_HIGH} h) s""")
def share_gap(spark, sf):
    return aggregate.share_gap(_flags(spark, sf), "vol", "macro")


@query("share_gap_variants", f"""SELECT variant, round(a, 6) + 0.0 AS s_a, round(b, 6) + 0.0 AS s_b, round(a - b, 6) + 0.0 AS gap FROM (
  SELECT v.variant, avg(CASE WHEN "index" = 'vol' AND (v.variant = 'all' OR date >= DATE '1998-01-01') THEN high END) AS a,
    avg(CASE WHEN "index" = 'macro' AND (v.variant = 'all' OR date >= DATE '1998-01-01') THEN high END) AS b FROM {_HIGH} h, (VALUES ('all'), ('late')) AS v(variant) GROUP BY 1) s""")
def share_gap_variants(spark, sf):
    """Gap over all months and after a splice date."""
    return states.share_gap_by_variant(_flags(spark, sf), "vol", "macro",
                                       {"all": F.lit(True), "late": F.col("date") >= "1998-01-01"})


@query("aligned_thresholds", """
WITH s AS (SELECT "index", avg(x) AS m, stddev_samp(x) AS sd FROM driver GROUP BY 1),
z AS (SELECT d."index", min((x - m) / sd) AS lo, max((x - m) / sd) AS hi, quantile_cont((x - m) / sd, 0.5) AS mid FROM driver d JOIN s USING ("index") WHERE x IS NOT NULL GROUP BY 1),
t AS (SELECT "index", CASE WHEN "index" = 'macro' THEN theta * 10 ELSE theta END AS theta FROM theta)
SELECT t."index", round(theta, 4) + 0.0 AS theta, round(CASE WHEN (theta - m) / sd <= lo OR (theta - m) / sd >= hi THEN mid ELSE (theta - m) / sd END, 4) + 0.0 AS theta_scaled,
  CASE WHEN (theta - m) / sd <= lo OR (theta - m) / sd >= hi THEN 'scaled+median' ELSE 'scaled' END AS space FROM t JOIN s USING ("index") JOIN z USING ("index")""", digits=4)
def aligned_thresholds(spark, sf):
    """One threshold inside its driver's range, one far outside."""
    theta = I.thresholds(spark, sf).withColumn("theta", F.when(F.col("index") == "macro", F.col("theta") * 10).otherwise(F.col("theta")))
    return states.align_threshold(I.driver(spark, sf), theta, value="x")


@query("fitted_length", """
WITH r AS (SELECT "index", value, row_number() OVER (PARTITION BY "index" ORDER BY date DESC) AS back FROM idx)
SELECT n."index", (n.k - s.back + 1)::INT AS date, round(r.value, 6) + 0.0 AS value FROM (VALUES ('vol', 60), ('macro', 90)) AS n("index", k)
JOIN (SELECT unnest(range(1, 91)) AS back) s ON s.back <= n.k LEFT JOIN r ON r."index" = n."index" AND r.back = s.back""")
def fitted_length(spark, sf):
    """One path cut to 60 rows, one padded to 90."""
    want = spark.createDataFrame([("vol", 60), ("macro", 90)], "index string, n_total int")
    return states.fit_length(I.indices(spark, sf), want, order="date")


@query("key_duplicates", """SELECT 'duplicate_keys' AS "check", 'error' AS level, count(*) AS n_bad FROM (SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(*) > 1) d""")
def key_duplicates(spark, sf):
    from stratawave.sources.readers import read_table

    return checks.key_duplicates(read_table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])
