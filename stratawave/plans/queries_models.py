"""Queries on fitted models, responses and variance shares."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratawave.operators import fit, responses, series, shares, states
from stratawave.plans import inputs as I
from stratawave.plans.registry import cte, query, sel
from stratawave.session import cut_lineage

H = 24


def _split(spark, sf, vectors=None):
    """Design rows and fits of both regimes."""
    v = vectors or I.pair_vectors(spark, sf)
    rows = fit.regime_rows(v, I.median_spec(v), [1], [I.DELAY])
    return rows, fit.ols(rows)


def _pooled(spark, sf, vectors=None):
    rows = fit.pooled_rows(vectors or I.pair_vectors(spark, sf), 1)
    return rows, fit.ols(rows, "resid")


def _long_cells(source: str, cells: list[tuple[str, str]], head: str, extra: str = "") -> str:
    """SQL that turns named columns of one row per fit into long rows."""
    return " UNION ALL ".join(f"SELECT {head}, {labels}, {value} AS value{extra} FROM {source}" for labels, value in cells)


_COEF = [
    ("s1 AS equation, 'intercept' AS regressor, 0 AS lag", "c1"), ("s1, s1, 1", "b11"), ("s1, s2, 1", "b12"),
    ("s2, 'intercept', 0", "c2"), ("s2, s1, 1", "b21"), ("s2, s2, 1", "b22"),
]
_COV = [("s1 AS i, s1 AS j", "g11"), ("s1, s2", "g12"), ("s2, s1", "g12"), ("s2, s2", "g22")]

# ------------------------------------------------------------------- design


@query("design_rows", """
SELECT model, date, t::INT AS t, round(y1, 6) + 0.0 AS y1, round(y2, 6) + 0.0 AS y2, round(x1, 6) + 0.0 AS x1, round(x2, 6) + 0.0 AS x2,
  round(q1, 4) + 0.0 AS q1, round(q2, 4) + 0.0 AS q2 FROM dz""")
def design_rows(spark, sf):
    """Standardised pair, its first lag and the delayed drivers."""
    rows = fit.design(I.pair_vectors(spark, sf), 1, [1, 2])
    return rows.select("model", "date", "t", F.col("y")[0].alias("y1"), F.col("y")[1].alias("y2"), F.col("x")[1].alias("x1"),
                       F.col("x")[2].alias("x2"), F.round(F.col("xq")[0], 4).alias("q1"), F.round(F.col("xq")[1], 4).alias("q2"))


_Z = ["1.0", "x1", "x2", "y1", "y2"]


@query("product_sums", "SELECT model, i::INT AS i, j::INT AS j, round(value, 5) + 0.0 AS value FROM (" + " UNION ALL ".join(
    f"SELECT model, {i} AS i, {j} AS j, sum({a} * {b})::DOUBLE AS value FROM dz GROUP BY 1" for i, a in enumerate(_Z) for j, b in enumerate(_Z)) + ") s", digits=5)
def product_sums(spark, sf):
    """Sums of products of [1, lags, values] per model."""
    rows = fit.design(I.pair_vectors(spark, sf), 1).select("model", F.concat("x", "y").alias("z"))
    return fit.total_products(fit.product_sums(rows, ["model"]), ["model"])


@query("return_covariances", f"""
SELECT a.series AS i, b.series AS j, round(covar_samp(a.ret, b.ret), 8) + 0.0 AS value, count(*)::DOUBLE AS n FROM cret a JOIN cret b ON a.date = b.date GROUP BY 1, 2""", digits=8)
def return_covariances(spark, sf):
    names = F.array(*[F.lit(t) for t in I.TYPES])
    return fit.covariances(I.type_vectors(spark, sf)).select(F.get(names, "i").alias("i"), F.get(names, "j").alias("j"), "value", "n")


# --------------------------------------------------------------------- fits


@query("pooled_coefficients", "SELECT model, regime, equation, regressor, lag, round(value, 6) + 0.0 AS value FROM (" + _long_cells("pfit", _COEF, "model, regime") + ") c")
def pooled_coefficients(spark, sf):
    return fit.coefficients(_pooled(spark, sf)[1])


@query("pooled_covariance", "SELECT model, regime, i, j, round(value, 6) + 0.0 AS value FROM (" + _long_cells("pfit", _COV, "model, regime") + ") c")
def pooled_covariance(spark, sf):
    return fit.square_table(_pooled(spark, sf)[1])


@query("regime_coefficients", "SELECT model, regime, equation, regressor, lag, round(value, 6) + 0.0 AS value FROM (" + _long_cells("sfit", _COEF, "model, regime") + ") c")
def regime_coefficients(spark, sf):
    return fit.coefficients(_split(spark, sf)[1])


@query("regime_covariance", "SELECT model, regime, i, j, round(value, 6) + 0.0 AS value FROM (" + _long_cells("sfit", _COV, "model, regime") + ") c")
def regime_covariance(spark, sf):
    return fit.square_table(_split(spark, sf)[1])


_EQ = """SELECT model, regime, s1 AS equation, n, rss1 AS rss, 1 - rss1 / (n * y1y1) AS r2 FROM sfit
UNION ALL SELECT model, regime, s2, n, rss2, 1 - rss2 / (n * y2y2) FROM sfit"""


@query("regime_equations", f"""
SELECT model, regime, equation, n AS n_obs, round(rss, 5) + 0.0 AS rss, round(r2, 5) + 0.0 AS r2, round(n * ln(rss / n) + 6, 5) + 0.0 AS aic,
  round(n * ln(rss / n) + 3 * ln(n), 5) + 0.0 AS bic FROM ({_EQ}) e""", digits=5)
def regime_equations(spark, sf):
    """R², AIC and BIC per equation."""
    return fit.equation_table(_split(spark, sf)[1])


@query("information_criteria", f"SELECT model, round(sum(n * ln(rss / n) + 3 * ln(n)), 5) + 0.0 AS bic, round(sum(n * ln(rss / n) + 6), 5) + 0.0 AS aic FROM ({_EQ}) e GROUP BY 1", digits=5)
def information_criteria(spark, sf):
    """Criteria summed over equations and both regimes."""
    return fit.equation_table(_split(spark, sf)[1]).groupBy("model").agg(F.sum("bic").alias("bic"), F.sum("aic").alias("aic"))


_PROBS = np.linspace(0.15, 0.85, 25)


def _search_sql(rows: str, grid: str, digits: int = 6) -> str:
    """Every candidate split of a two-variable model with one lag, solved in closed form."""
    moments = I._moments("cells").replace("model, regime,", "model, delay, theta, regime,", 1).replace("GROUP BY 1, 2", "GROUP BY 1, 2, 3, 4")
    return f"""
WITH d AS ({rows}), g AS ({grid}),
cells AS (SELECT d.*, g.theta, CASE WHEN q <= theta THEN 'low' ELSE 'high' END AS regime FROM d JOIN g USING (model, delay)),
m AS ({moments}),
f AS (SELECT model, delay, theta, regime, n, (x1y1 * x2x2 - x2y1 * x1x2) / det AS b11, (x2y1 * x1x1 - x1y1 * x1x2) / det AS b12,
  (x1y2 * x2x2 - x2y2 * x1x2) / det AS b21, (x2y2 * x1x1 - x1y2 * x1x2) / det AS b22, x1y1, x2y1, x1y2, x2y2, y1y1, y2y2
  FROM (SELECT *, x1x1 * x2x2 - x1x2 * x1x2 AS det FROM m) e),
r AS (SELECT model, delay, theta, sum(n) AS n, sum(CASE WHEN regime = 'low' THEN n ELSE 0 END) AS n_low, count(*) AS k, min(n) AS least,
  sum(n * ln(y1y1 - b11 * x1y1 - b12 * x2y1) + n * ln(y2y2 - b21 * x1y2 - b22 * x2y2) + 6 * ln(n)) AS score FROM f GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, delay, theta) AS rn FROM r
  WHERE k = 2 AND n_low / n >= 0.15 AND 1 - n_low / n >= 0.15 AND least >= {{least}})
SELECT model, 1 AS p, delay::INT AS delay, round(theta, 4) + 0.0 AS theta, round(score, 4) + 0.0 AS score, round(n_low / n, 4) + 0.0 AS share_low,
  round(1 - n_low / n, 4) + 0.0 AS share_high, {{tail}} FROM b WHERE rn = 1"""


def _type8(source: str, probs: str) -> str:
    return f"""SELECT a.model, a.delay, p.q AS prob, CASE WHEN pos - near < 1e-12 THEN a.v ELSE a.v + (pos - near) * (b.v - a.v) END AS theta FROM (
  SELECT model, delay, q, pos, floor(pos + 8.881784197001252e-16 * pos) AS near FROM (
    SELECT DISTINCT model, delay, p.q, (n + 1.0::DOUBLE / 3) * p.q + 1.0::DOUBLE / 3 AS pos FROM {source}, (VALUES {probs}) AS p(q)) x) p
  JOIN {source} a ON a.model = p.model AND a.delay = p.delay AND a.rn = near JOIN {source} b ON b.model = p.model AND b.delay = p.delay AND b.rn = near + 1"""


cte("ddl", """
SELECT model, s1, s2, 1 AS delay, x1, x2, y1, y2, q1 AS q FROM dz WHERE q1 IS NOT NULL
UNION ALL SELECT model, s1, s2, 2, x1, x2, y1, y2, q2 FROM dz WHERE q2 IS NOT NULL""")
cte("ranked", "SELECT model, delay, q AS v, row_number() OVER (PARTITION BY model, delay ORDER BY q) AS rn, count(*) OVER (PARTITION BY model, delay) AS n FROM ddl")
_probs_sql = ", ".join(f"({float(p)!r}::DOUBLE)" for p in _PROBS)


@query("threshold_search", _search_sql("SELECT * FROM ddl", "SELECT DISTINCT model, delay, theta FROM (" + _type8("ranked", _probs_sql) + ") t").replace(
    "{least}", "30").replace("{tail}", "n_low::BIGINT AS n_low, (n - n_low)::BIGINT AS n_high, NULL AS issue"), digits=4)
def threshold_search(spark, sf):
    """Best delay and threshold of six models over a quantile grid."""
    return fit.search_threshold(I.pair_vectors(spark, sf), [1], [1, 2], ngrid=25)


cte("mzs", """SELECT *, CASE WHEN count(q) OVER w = 3 THEN avg(q) OVER w END AS qs FROM mz WINDOW w AS (PARTITION BY model ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
cte("dls", """
SELECT model, s1, s2, 1 AS delay, x1, x2, y1, y2, q FROM (SELECT *, lag(y1) OVER w AS x1, lag(y2) OVER w AS x2, lag(qs) OVER w AS q FROM (SELECT model, s1, s2, date, t, y1, y2, qs FROM mzs) z
WINDOW w AS (PARTITION BY model ORDER BY date)) s WHERE t > 1 AND q IS NOT NULL""")
cte("rankeds", "SELECT model, delay, q AS v, row_number() OVER (PARTITION BY model, delay ORDER BY q) AS rn, count(*) OVER (PARTITION BY model, delay) AS n FROM dls")


@query("threshold_search_linear", _search_sql("SELECT * FROM dls", "SELECT e.model, e.delay, lo + (hi - lo) * i / 19 AS theta FROM (SELECT model, delay, min(theta) AS lo, max(theta) AS hi FROM ("
    + _type8("rankeds", "(0.15::DOUBLE), (0.85::DOUBLE)") + ") t GROUP BY 1, 2) e, (SELECT unnest(range(0, 20)) AS i) u").replace("{least}", "5").replace("{tail}", "FALSE AS fallback"), digits=4)
def threshold_search_linear(spark, sf):
    """Evenly spaced candidates on the smoothed driver."""
    return fit.search_with_fallback(I.pair_vectors(spark, sf), [1], [1], smooth=3, ngrid=20, trim=0.15)


cte("uz", """
SELECT model, date, q, row_number() OVER m AS t, (ret - avg(ret) OVER a) / stddev_samp(ret) OVER a AS y FROM (
  SELECT d."index" || ':' || series AS model, r.date, ret, value AS q FROM wret r JOIN widx d ON d.date = r.date WHERE ret IS NOT NULL AND value IS NOT NULL) j
WINDOW m AS (PARTITION BY model ORDER BY date), a AS (PARTITION BY model)""")
cte("ud", """
SELECT model, u.delay, x1, x2, y, CASE u.delay WHEN 1 THEN q1 ELSE q2 END AS q FROM (
  SELECT *, lag(y) OVER w AS x1, lag(y, 2) OVER w AS x2, lag(q) OVER w AS q1, lag(q, 2) OVER w AS q2 FROM uz WINDOW w AS (PARTITION BY model ORDER BY date)) s, (VALUES (1), (2)) AS u(delay)
WHERE t > 2 AND CASE u.delay WHEN 1 THEN q1 ELSE q2 END IS NOT NULL""")
cte("uranked", "SELECT model, delay, q AS v, row_number() OVER (PARTITION BY model, delay ORDER BY q) AS rn, count(*) OVER (PARTITION BY model, delay) AS n FROM ud")
_few_probs = ", ".join(f"({float(p)!r}::DOUBLE)" for p in np.linspace(0.15, 0.85, 20))


@query("threshold_search_lags", f"""
WITH g AS (SELECT DISTINCT model, delay, theta FROM ({_type8("uranked", _few_probs)}) t),
m AS (SELECT model, d.delay, theta, q <= theta AS low, count(*) AS n, covar_pop(x1, x1) AS x1x1, covar_pop(x1, x2) AS x1x2, covar_pop(x2, x2) AS x2x2, covar_pop(x1, y) AS x1y,
  covar_pop(x2, y) AS x2y, covar_pop(y, y) AS yy FROM ud d JOIN g USING (model, delay) GROUP BY 1, 2, 3, 4),
f AS (SELECT model, delay, theta, low, n, unnest([1, 2]) AS p, unnest([yy - x1y * x1y / x1x1,
  yy - (x1y * (x1y * x2x2 - x2y * x1x2) + x2y * (x2y * x1x1 - x1y * x1x2)) / (x1x1 * x2x2 - x1x2 * x1x2)]) AS s2 FROM m),
r AS (SELECT model, delay, theta, p, count(*) AS k, min(n) AS least, sum(n) AS n, sum(CASE WHEN low THEN n ELSE 0 END) AS n_low, sum(n * ln(s2) + (1 + p) * ln(n)) AS score FROM f GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score, delay, theta, p) AS rn FROM r WHERE k = 2 AND n_low / n >= 0.15 AND 1 - n_low / n >= 0.15 AND least >= 30)
SELECT model, p::INT AS p, delay::INT AS delay, round(theta, 4) + 0.0 AS theta, round(score, 4) + 0.0 AS score, round(n_low / n, 4) + 0.0 AS share_low,
  round(1 - n_low / n, 4) + 0.0 AS share_high, n_low::BIGINT AS n_low, (n - n_low)::BIGINT AS n_high, NULL AS issue FROM b WHERE rn = 1""", digits=4)
def threshold_search_lags(spark, sf):
    """Lag order, delay and threshold of every type on its own, with each index as the driver."""
    returns = cut_lineage(series.log_return(I.unit_prices(spark, sf, unit="week"), out="ret"))
    q = I.indices(spark, sf, "week")
    models = returns.select("series").distinct().withColumn("index", F.explode(F.array(F.lit("vol"), F.lit("macro")))).withColumn("model", F.concat_ws(":", "index", "series"))
    members = models.select("model", "series", F.lit(0).alias("pos"))
    drivers = models.join(q, "index").select("model", "date", F.col("value").alias("q"))
    return fit.search_threshold(cut_lineage(fit.model_vectors(returns, members, drivers)), [1, 2], [1, 2], ngrid=20)


def wide_vectors(spark, sf):
    """Two models with the weekly series of all brands."""
    returns = cut_lineage(series.log_return(I.unit_prices(spark, sf, "p_brand", "week"), out="ret"))
    pos = F.regexp_extract("series", r"(\d+)", 1).cast("int").alias("pos")
    members = returns.select("series").distinct().select(F.explode(F.array(F.lit("vol"), F.lit("macro"))).alias("model"), "series", pos)
    q = I.indices(spark, sf, "week").select(F.col("index").alias("model"), "date", F.col("value").alias("q"))
    return cut_lineage(fit.model_vectors(returns, members, q))


@query("threshold_search_wide")
def threshold_search_wide(spark, sf):
    """Search over three lag orders, two delays and a hundred thresholds with every brand."""
    return fit.search_threshold(wide_vectors(spark, sf), [2, 3, 4], [1, 2], ngrid=100, min_obs=30)


# -------------------------------------------------------------- diagnostics

_ROOT = """CASE WHEN (b11 + b22) * (b11 + b22) - 4 * (b11 * b22 - b12 * b21) >= 0
  THEN (abs(b11 + b22) + sqrt((b11 + b22) * (b11 + b22) - 4 * (b11 * b22 - b12 * b21))) / 2 ELSE sqrt(b11 * b22 - b12 * b21) END"""
cte("sroot", f"SELECT model, regime, n, {_ROOT} AS rho, g11 > 0 AND g11 * g22 > g12 * g12 AS pd, ln(g11 * g22 - g12 * g12) AS log_det FROM sfit")


@query("stability_checks", """
SELECT model, regime, n AS n_obs, 2 AS k, 1 AS p, round(rho, 6) + 0.0 AS rho, rho < 1 AS stable, pd AS sigma_pd, round(log_det, 6) + 0.0 AS log_det,
  n >= 10 AS enough_obs, pd AND rho < 1 - 1e-6 AND n >= 10 AS ok FROM sroot""")
def stability_checks(spark, sf):
    return fit.stability(_split(spark, sf)[1])


cte("sres", """
SELECT r.model, r.regime, r.date, r.t, f.s1 AS variable, y1 AS y, f.c1 + f.b11 * x1 + f.b12 * x2 AS yhat FROM srows r JOIN sfit f ON f.model = r.model AND f.regime = r.regime
UNION ALL SELECT r.model, r.regime, r.date, r.t, f.s2, y2, f.c2 + f.b21 * x1 + f.b22 * x2 FROM srows r JOIN sfit f ON f.model = r.model AND f.regime = r.regime""")


@query("fitted_values", "SELECT model, regime, date, t::INT AS t, variable, round(y, 6) + 0.0 AS y, round(yhat, 6) + 0.0 AS yhat, round(y - yhat, 6) + 0.0 AS resid FROM sres")
def fitted_values(spark, sf):
    return fit.fitted(*_split(spark, sf))


@query("fit_quality", """
SELECT model, regime, variable, count(*) AS n, round(sum((y - yhat) * (y - yhat)), 5) + 0.0 AS rss, round(var_pop(y) * count(*), 5) + 0.0 AS sst,
  round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 5) + 0.0 AS r2 FROM sres GROUP BY 1, 2, 3""", digits=5)
def fit_quality(spark, sf):
    return fit.fit_quality(fit.fitted(*_split(spark, sf)))


_acf = ", ".join(f"sum(e * l{m}) / sum(e * e) AS a{m}" for m in range(1, 13))
_lags = ", ".join(f"lag(e, {m}) OVER w AS l{m}" for m in range(1, 13))
_q = " + ".join(f"a{m} * a{m} / (n - {m})" for m in range(1, 13))
_tail12 = "exp(-q / 2) * (" + " + ".join(f"power(q / 2, {i}) / {f}" for i, f in enumerate([1, 1, 2, 6, 24, 120])) + ")"
cte("lbox", f"""
SELECT model, regime, variable, n, q, {_tail12} AS p FROM (SELECT model, regime, variable, n, n * (n + 2) * ({_q}) AS q FROM (
  SELECT model, regime, variable, count(*) AS n, {_acf} FROM (SELECT model, regime, variable, t, e, {_lags} FROM (
    SELECT model, regime, variable, t, y - yhat - avg(y - yhat) OVER (PARTITION BY model, regime, variable) AS e FROM sres) r WINDOW w AS (PARTITION BY model, regime, variable ORDER BY t)) l
  GROUP BY 1, 2, 3) a) b""")


@query("residual_whiteness", "SELECT model, regime, variable, n, 12 AS lag, round(q, 5) + 0.0 AS q, round(p, 5) + 0.0 AS p FROM lbox", digits=5)
def residual_whiteness(spark, sf):
    return fit.ljung_box(fit.fitted(*_split(spark, sf)))


cte("contrast", """
SELECT model, stat, exp(-stat / 2) * (1 + stat / 2 + stat * stat / 8) AS p FROM (SELECT s.model, 2 * (s.ll + p.n * ln(p.g11 * p.g22 - p.g12 * p.g12)) AS stat
FROM (SELECT model, sum(-n * log_det) AS ll FROM sroot GROUP BY 1) s JOIN pfit p ON p.model = s.model) c""")


@query("split_contrast", """SELECT model, round(stat, 4) + 0.0 AS stat, 6 AS df, CASE WHEN stat >= 0 THEN round(greatest(p, 2.2250738585072014e-308), 4) + 0.0 END AS p FROM contrast""", digits=4)
def split_contrast(spark, sf):
    v = I.pair_vectors(spark, sf)
    return fit.split_contrast(fit.stability(_split(spark, sf, v)[1]), fit.stability(_pooled(spark, sf, v)[1]))


def _spec(vectors, rows):
    """The given split with its shares."""
    shares_ = rows.groupBy("model").agg(F.avg((F.col("regime") == "low").cast("double")).alias("share_low"))
    return I.median_spec(vectors).join(shares_, "model").withColumn("share_high", 1 - F.col("share_low"))


cte("sides", """
SELECT model, max(CASE WHEN regime = 'low' THEN n END) AS nl, max(CASE WHEN regime = 'high' THEN n END) AS nh,
  max(CASE WHEN regime = 'low' THEN rho END) AS rl, max(CASE WHEN regime = 'high' THEN rho END) AS rh FROM sroot GROUP BY 1""")


@query("model_selection_summary", """
SELECT s.model, 1 AS p, 1 AS d, round(theta, 4) + 0.0 AS "c_star", nl AS "T_L", nh AS "T_H", round(nh / (nl + nh), 4) + 0.0 AS "s_H", round(rl, 4) + 0.0 AS "lambda_max_L",
  round(rh, 4) + 0.0 AS "lambda_max_H", round(pl, 4) + 0.0 AS "lb_p_L", round(ph, 4) + 0.0 AS "lb_p_H", round(stat, 4) + 0.0 AS contrast_stat,
  CASE WHEN stat >= 0 THEN round(c.p, 4) + 0.0 END AS contrast_p
FROM sides s JOIN mtheta USING (model) JOIN contrast c ON c.model = s.model
JOIN (SELECT model, min(CASE WHEN regime = 'low' THEN p END) AS pl, min(CASE WHEN regime = 'high' THEN p END) AS ph FROM lbox GROUP BY 1) l ON l.model = s.model""", digits=4)
def model_selection_summary(spark, sf):
    v = I.pair_vectors(spark, sf)
    rows, fits = _split(spark, sf, v)
    fits = cut_lineage(fits)
    checks = fit.stability(fits)
    white = fit.min_whiteness(fit.ljung_box(fit.fitted(rows, fits)))
    contrast = fit.split_contrast(checks, fit.stability(_pooled(spark, sf, v)[1]))
    return fit.selection_summary(_spec(v, rows), checks, white, contrast)


@query("model_registry", """
SELECT model, 2 AS k, 1 AS p, 1 AS delay, round(theta, 4) + 0.0 AS theta, round(nl / (nl + nh), 4) + 0.0 AS theta_pct, nl AS low_obs, nh AS high_obs, nl - 3 AS df_low_per_eq, nh - 3 AS df_high_per_eq,
  round(rl, 3) + 0.0 AS low_rho, round(rh, 3) + 0.0 AS high_rho, rl < 1 AS low_stable, rh < 1 AS high_stable FROM sides JOIN mtheta USING (model)""", digits=4)
def model_registry(spark, sf):
    v = I.pair_vectors(spark, sf)
    rows, fits = _split(spark, sf, v)
    return fit.model_registry(_spec(v, rows), fit.stability(fits))


cte("rcov", """
SELECT model, any_value(s1) AS s1, any_value(s2) AS s2, sum((n - 1) * g11) / (sum(n) - 1) AS g11, sum((n - 1) * g12) / (sum(n) - 1) AS g12, sum((n - 1) * g22) / (sum(n) - 1) AS g22 FROM sfit GROUP BY 1""")


@query("residual_covariance", "SELECT model, i, j, round(value, 6) + 0.0 AS value FROM (" + _long_cells("rcov", _COV, "model") + ") c")
def residual_covariance(spark, sf):
    """Covariance of the residuals of both regimes stacked."""
    return fit.square_table(fit.residual_covariance(_split(spark, sf)[1]), keys=["model"])


@query("impact_cholesky", "SELECT model, i, j, round(value, 6) + 0.0 AS value FROM (" + _long_cells(
    "rcov", [("s1 AS i, s1 AS j", "sqrt(g11)"), ("s1, s2", "0.0::DOUBLE"), ("s2, s1", "g12 / sqrt(g11)"), ("s2, s2", "sqrt(g22 - g12 * g12 / g11)")], "model") + ") c")
def impact_cholesky(spark, sf):
    """Lower triangular impact matrix with A A' = Sigma."""
    return fit.square_table(fit.impact_matrices(fit.residual_covariance(_split(spark, sf)[1])), "a", ["model"])


_FLIP1 = "CASE WHEN s1 = 'ECONOMY' OR (s1 = 'SMALL' AND g12 > 0) THEN -1 ELSE 1 END"


@query("impact_sign", "SELECT model, i, j, round(value, 6) + 0.0 AS value FROM (" + _long_cells(
    "rcov", [("s1 AS i, s1 AS j", f"{_FLIP1} * sqrt(g11)"), ("s1, s2", "0.0::DOUBLE"), ("s2, s1", f"{_FLIP1} * 0.9::DOUBLE * g12 / sqrt(g11)"),
             ("s2, s2", "CASE WHEN s2 = 'PROMO' THEN -1 ELSE 1 END * sqrt(g22 - 0.81::DOUBLE * g12 * g12 / g11)")], "model") + ") c")
def impact_sign(spark, sf):
    """Shrunk covariance, and columns flipped to satisfy sign constraints: on the own effect
    of two shocks, and on the effect of a third on the other variable."""
    signs = [("ECONOMY", "ECONOMY", "-"), ("PROMO", "PROMO", "-"), ("STANDARD", "SMALL", "-")]
    covs = fit.residual_covariance(_split(spark, sf)[1])
    return fit.square_table(fit.impact_matrices(covs, "sign", shrink=0.1, signs=signs), "a", ["model"])


@query("impact_given", "SELECT model, method, i, j, round(value, 6) + 0.0 AS value FROM (" + " UNION ALL ".join(
    _long_cells(f"(SELECT *, '{m}' AS method FROM rcov)", list(zip(["s1 AS i, s1 AS j", "s1, s2", "s2, s1", "s2, s2"], v)), "model, method")
    for m, v in (("unit", ["1.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "1.0::DOUBLE"]), ("custom", ["1.0::DOUBLE", "0.25::DOUBLE", "-0.5::DOUBLE", "2.0::DOUBLE"]),
                 ("reordered", ["sqrt(g11 - g12 * g12 / g22)", "g12 / sqrt(g22)", "0.0::DOUBLE", "sqrt(g22)"]))) + ") c")
def impact_given(spark, sf):
    """Impact matrices that need no decomposition, and one whose second variable comes first."""
    covs = cut_lineage(fit.residual_covariance(_split(spark, sf)[1]))
    parts = {"unit": fit.impact_matrices(covs, "unit"), "custom": fit.impact_matrices(covs, "custom", custom=[1.0, 0.25, -0.5, 2.0]),
             "reordered": fit.impact_matrices(covs, ordering=["LARGE", "PROMO", "STANDARD"])}
    tables = [fit.square_table(p, "a", ["model"]).withColumn("method", F.lit(m)) for m, p in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("residual_covariance_choices", """
WITH w AS (SELECT model, any_value(s1) AS s1, any_value(s2) AS s2, sum((n - 1) * g11) / (sum(n) - 2) AS g11, sum((n - 1) * g12) / (sum(n) - 2) AS g12,
  sum((n - 1) * g22) / (sum(n) - 2) AS g22 FROM sfit GROUP BY 1),
t AS (SELECT 'weighted' AS choice, * FROM w
  UNION ALL SELECT 'stored', model, s1, s2, CASE WHEN model LIKE 'vol%' THEN 2.0 ELSE g11 END, CASE WHEN model LIKE 'vol%' THEN 0.5 ELSE g12 END, CASE WHEN model LIKE 'vol%' THEN 1.0 ELSE g22 END FROM rcov
  UNION ALL SELECT 'identity', model, s1, s2, 1.0, 0.0, 1.0 FROM rcov)
SELECT choice, model, i, j, round(value, 6) + 0.0 AS value FROM (""" + _long_cells("t", _COV, "choice, model") + ") c")
def residual_covariance_choices(spark, sf):
    """Residual covariances by degrees of freedom, with stored ones before fitted ones, and of
    fits without a usable covariance."""
    fits = cut_lineage(_split(spark, sf)[1])
    stored = fits.where(F.col("model").startswith("vol")).select("model", F.array(*[F.lit(v) for v in (2.0, 0.5, 0.5, 1.0)]).alias("sigma")).distinct()
    parts = {"weighted": fit.residual_covariance(fits, "weighted"), "stored": fit.residual_covariance(fits, stored=stored),
             "identity": fit.residual_covariance(fits.withColumn("sigma", F.slice("sigma", 1, 2)))}
    tables = [fit.square_table(p, keys=["model"]).withColumn("choice", F.lit(c)) for c, p in parts.items()]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


@query("model_readiness", """
SELECT model, reason = 'ready' AS ok, reason, 4 AS horizon FROM (
  SELECT model, CASE WHEN f.n_regimes < 2 THEN 'basic_schema' WHEN coalesce(n_state, 0) <> n_fit OR coalesce(n_states, 0) <> 2 THEN 'regime_index' ELSE 'ready' END AS reason
  FROM (SELECT model, sum(n) AS n_fit, count(*) AS n_regimes FROM sfit GROUP BY 1) f LEFT JOIN (
    SELECT model, count(*) AS n_state, count(DISTINCT regime) AS n_states FROM srows WHERE NOT (model LIKE '%ECONOMY%' AND regime <> 'low') GROUP BY 1) s USING (model)) r""")
def model_readiness(spark, sf):
    """Complete models, and some whose state path lost its rows of one state."""
    rows, fits = _split(spark, sf)
    path = rows.select("model", F.when(F.col("regime") == "low", 1).otherwise(2).alias("state"))
    path = path.where(~(F.col("model").contains("ECONOMY") & (F.col("state") == 2)))
    return states.readiness(fits, path, responses.moving_average(fits, 4))


# ---------------------------------------------------------------- responses


def _phi(source: str, horizon: int) -> str:
    """Powers of the lag matrix of every fit, as a recursive table expression body."""
    return f"""SELECT model, regime, 0 AS h, 1.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p21, 1.0::DOUBLE AS p22 FROM {source}
UNION ALL SELECT f.model, f.regime, h + 1, f.b11 * p11 + f.b12 * p21, f.b11 * p12 + f.b12 * p22, f.b21 * p11 + f.b22 * p21, f.b21 * p12 + f.b22 * p22
FROM {{me}} q JOIN {source} f ON f.model = q.model AND f.regime = q.regime WHERE h < {horizon}"""


cte("phi", _phi("sfit", 36).replace("{me}", "phi"))
cte("pphi", _phi("pfit", 36).replace("{me}", "pphi"))


def _entries(phi: str, source: str, e11: str, e12: str, e21: str, e22: str) -> str:
    """Long rows; e_ij is the response of variable i to a shock in j."""
    cells = [("s1", "s1", e11), ("s2", "s1", e12), ("s1", "s2", e21), ("s2", "s2", e22)]
    return " UNION ALL ".join(
        f"SELECT q.model, q.regime, {imp} AS impulse, {resp} AS response, h, {v} AS value FROM {phi} q JOIN {source} f ON f.model = q.model AND f.regime = q.regime"
        for imp, resp, v in cells)


_G = ("(p11 * g11 + p12 * g12) / sqrt(g11)", "(p11 * g12 + p12 * g22) / sqrt(g22)", "(p21 * g11 + p22 * g12) / sqrt(g11)", "(p21 * g12 + p22 * g22) / sqrt(g22)")
cte("irf", _entries("phi", "sfit", *_G))
cte("pirf", _entries("pphi", "pfit", *_G))
_CURVE = "model regime impulse response"


@query("moving_average_coefficients", sel(_CURVE + " h", "value", "(" + _entries("phi", "sfit", "p11", "p12", "p21", "p22") + f") e WHERE h <= {H}"))
def moving_average_coefficients(spark, sf):
    return responses.moving_average(_split(spark, sf)[1], H)


@query("generalized_responses", sel(_CURVE + " h", "value", f"irf WHERE h <= {H}"))
def generalized_responses(spark, sf):
    return responses.generalized(_split(spark, sf)[1], H)


_SD = _entries("phi", "sfit", "p11 * sqrt(g11)", "p12 * sqrt(g22)", "p21 * sqrt(g11)", "p22 * sqrt(g22)")
cte("sdirf", f"SELECT model, regime, impulse, response, h + 1 AS h, value FROM ({_SD}) e WHERE h < 12 UNION ALL SELECT model, regime, impulse, response, 0, 0.0::DOUBLE FROM ({_SD}) z WHERE h = 0")


@query("shock_responses", sel(_CURVE + " h", "value", "sdirf"))
def shock_responses(spark, sf):
    """Responses to a one-sd shock; the impact row is h = 1."""
    return responses.shock_responses(_split(spark, sf)[1], 12, "sd")


@query("combined_responses", "SELECT model, 'combined' AS regime, impulse, response, h, round(avg(value), 6) + 0.0 AS value FROM sdirf GROUP BY 1, 3, 4, 5")
def combined_responses(spark, sf):
    return responses.combined(shock_responses(spark, sf))


@query("regime_difference", f"""
SELECT model, impulse, response, h, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(high - low, 6) + 0.0 AS diff,
  round(sum(high - low) OVER (PARTITION BY model, impulse, response ORDER BY h), 6) + 0.0 AS cum_diff FROM (
  SELECT model, impulse, response, h, max(CASE WHEN regime = 'low' THEN value END) AS low, max(CASE WHEN regime = 'high' THEN value END) AS high FROM irf WHERE h <= {H} GROUP BY 1, 2, 3, 4) w""")
def regime_difference(spark, sf):
    return responses.regime_difference(generalized_responses(spark, sf))


@query("response_peaks", f"SELECT model, regime, impulse, response, round(max(abs(value)), 6) + 0.0 AS peak FROM irf WHERE h <= {H} GROUP BY 1, 2, 3, 4")
def response_peaks(spark, sf):
    return responses.peaks(generalized_responses(spark, sf))


@query("half_life_from_start", f"""
SELECT model, regime, impulse, response, min(CASE WHEN abs(value) <= 0.5 * top THEN h END) AS half_life FROM (
  SELECT *, max(abs(value)) OVER (PARTITION BY model, regime, impulse, response) AS top FROM irf WHERE h <= {H}) s GROUP BY 1, 2, 3, 4""")
def half_life_from_start(spark, sf):
    return responses.half_life_from_start(generalized_responses(spark, sf))


@query("half_life_from_peak", f"""
SELECT model, regime, impulse, response, min(CASE WHEN h >= pk AND abs(value) <= 0.5 * top THEN h END) - min(pk) AS half_life FROM (
  SELECT s.*, min(CASE WHEN abs(value) = top THEN h END) OVER (PARTITION BY model, regime, impulse, response) AS pk FROM (
    SELECT *, max(abs(value)) OVER (PARTITION BY model, regime, impulse, response) AS top FROM irf WHERE h <= {H}) s) q GROUP BY 1, 2, 3, 4""")
def half_life_from_peak(spark, sf):
    return responses.half_life_from_peak(generalized_responses(spark, sf))


def _envelope_sql(source: str) -> str:
    w = "PARTITION BY model, regime, impulse, response"
    return f"""SELECT model, regime, impulse, response, min(CASE WHEN env <= 0.6 * top AND before > 0.6 * top THEN h - 1 + CASE WHEN before = env THEN 1 ELSE (before - 0.6 * top) / (before - env) END - pk END) AS half_life,
  max(top) AS peak FROM (SELECT *, lag(env) OVER ({w} ORDER BY h) AS before FROM (
    SELECT *, min(x) OVER ({w} ORDER BY h) AS env FROM (SELECT s.*, min(CASE WHEN x = top THEN h END) OVER ({w}) AS pk FROM (
      SELECT *, abs(value) AS x, max(abs(value)) OVER ({w}) AS top FROM {source}) s) a WHERE h >= pk) e) b GROUP BY 1, 2, 3, 4"""


cte("hlife", _envelope_sql("irf"))
cte("phlife", _envelope_sql("pirf"))


@query("half_life_envelope", sel(_CURVE, "half_life", "hlife"))
def half_life_envelope(spark, sf):
    return responses.half_life_envelope(responses.generalized(_split(spark, sf)[1], 36))


def _groups(spark):
    return spark.createDataFrame([(t, "A" if t in ("ECONOMY", "LARGE", "MEDIUM") else "B") for t in I.TYPES], "response string, group string")


_GRP = "CASE WHEN response IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 'A' ELSE 'B' END"


@query("group_half_life", f"""
SELECT model, regime, {_GRP} AS "group", round(quantile_cont(m, 0.5), 6) + 0.0 AS half_life FROM (SELECT model, regime, response, quantile_cont(half_life, 0.5) AS m FROM hlife GROUP BY 1, 2, 3) s GROUP BY 1, 2, 3""")
def group_half_life(spark, sf):
    return responses.group_medians(half_life_envelope(spark, sf), _groups(spark), "half_life")


@query("group_persistence", f"""
SELECT model, regime, {_GRP} AS "group", round(quantile_cont(m, 0.5), 6) + 0.0 AS "PI" FROM (SELECT model, regime, response, quantile_cont(pi, 0.5) AS m FROM (
  SELECT model, regime, impulse, response, sum(abs(value)) AS pi FROM irf WHERE h <= {H} GROUP BY 1, 2, 3, 4) p GROUP BY 1, 2, 3) s GROUP BY 1, 2, 3""")
def group_persistence(spark, sf):
    return responses.group_medians(responses.persistence(generalized_responses(spark, sf), H), _groups(spark), "PI")


@query("amplification", f"""
SELECT model, impulse, response, round(lo, 6) + 0.0 AS peak_low, round(hi, 6) + 0.0 AS peak_high, round(lo / hi, 6) + 0.0 AS amplification FROM (
  SELECT model, impulse, response, max(CASE WHEN regime = 'low' THEN abs(value) END) AS lo, max(CASE WHEN regime = 'high' THEN abs(value) END) AS hi FROM irf WHERE h <= {H} GROUP BY 1, 2, 3) s""")
def amplification(spark, sf):
    return responses.amplification(generalized_responses(spark, sf))


@query("uplift_table", f"""
WITH a AS (SELECT model, {_GRP} AS g, quantile_cont(peak, 0.5) AS mp, quantile_cont(half_life, 0.5) AS hl FROM hlife WHERE regime = 'high' GROUP BY 1, 2),
b AS (SELECT model, {_GRP} AS g, quantile_cont(peak, 0.5) AS mp, quantile_cont(half_life, 0.5) AS hl FROM phlife GROUP BY 1, 2)
SELECT a.model, a.g AS "group", round(a.mp / b.mp, 6) + 0.0 AS peak_ratio, round(a.hl - b.hl, 6) + 0.0 AS d_half_life FROM a JOIN b ON a.model = b.model AND a.g = b.g""")
def uplift_table(spark, sf):
    """High regime against the pooled benchmark per group."""
    v = I.pair_vectors(spark, sf)
    high = responses.generalized(_split(spark, sf, v)[1].where(F.col("regime") == "high"), 36)
    return responses.uplift(high, responses.generalized(_pooled(spark, sf, v)[1], 36), _groups(spark))


@query("compared_runs", f"""
SELECT run, count(*) AS n, round(sum(abs(value)), 5) + 0.0 AS size FROM (SELECT 'split' AS run, value FROM irf WHERE h <= 6 UNION ALL SELECT 'pooled', value FROM pirf WHERE h <= 6) r GROUP BY 1""", digits=5)
def compared_runs(spark, sf):
    v = I.pair_vectors(spark, sf)
    a, b = responses.generalized(_split(spark, sf, v)[1], 6), responses.generalized(_pooled(spark, sf, v)[1], 6)
    return responses.compare_runs(a, b, ("split", "pooled")).groupBy("run").agg(F.count("*").alias("n"), F.sum(F.abs("value")).alias("size"))


@query("response_pairs", """
SELECT model, i AS impulse, r AS response, i || ' → ' || r AS pair, i <> r AS exported FROM (SELECT model, unnest([s1, s1, s2, s2]) AS i, unnest([s1, s2, s1, s2]) AS r FROM pairs) p""")
def response_pairs(spark, sf):
    rows, fits = _split(spark, sf)
    exported = responses.moving_average(fits, 1).where(F.col("impulse") != F.col("response"))
    return responses.pair_index(fits.select("model", "names").distinct(), exported)


# ---------------------------------------------------------- variance shares

_CUM = "sum(value * value * w) OVER (PARTITION BY model, regime, response, impulse ORDER BY h)"


@query("variance_shares", f"""
WITH c AS (SELECT model, regime, response, impulse, h, {_CUM} AS num FROM (SELECT *, CASE WHEN impulse IN ('ECONOMY', 'LARGE', 'MEDIUM') THEN 1 ELSE 2 END AS w FROM irf WHERE h <= 12) i)
SELECT model, regime, response, impulse, h AS t, round(num / sum(num) OVER (PARTITION BY model, regime, response, h), 6) + 0.0 AS fevd_share FROM c""")
def variance_shares(spark, sf):
    weights = _groups(spark).select(F.col("response").alias("impulse"), F.when(F.col("group") == "A", 1.0).otherwise(2.0).alias("var_w"))
    return shares.variance_shares(generalized_responses(spark, sf), 12, weights, keys=["model", "regime"])


@query("shares_per_step", sel("uncertainty regime response impulse t", "fevd_share", "fevd"))
def shares_per_step(spark, sf):
    return I.shares(spark, sf)


@query("normalised_shares", """
WITH d AS (SELECT uncertainty, regime, response, CASE WHEN impulse IN ('ECONOMY', 'LARGE') THEN 'both' ELSE impulse END AS impulse, t, fevd_share * 2 AS s FROM fevd),
s AS (SELECT uncertainty, regime, response, impulse, t, sum(s) AS s FROM d GROUP BY 1, 2, 3, 4, 5)
SELECT uncertainty, regime, response, impulse, t, round(s / sum(s) OVER (PARTITION BY uncertainty, regime, response, t), 6) + 0.0 AS fevd_share FROM s""")
def normalised_shares(spark, sf):
    """Two impulses folded into one name and shares that do not sum to one."""
    doubled = I.shares(spark, sf).withColumns({
        "impulse": F.when(F.col("impulse").isin("ECONOMY", "LARGE"), "both").otherwise(F.col("impulse")), "fevd_share": F.col("fevd_share") * 2})
    return shares.normalise_shares(doubled)


_IGRP = _GRP.replace("response", "impulse")
_GSH = f"""SELECT model, regime, horizon, g AS "group", avg(s) AS share FROM (SELECT model, regime, horizon, response, g, n / sum(n) OVER (PARTITION BY model, regime, horizon, response) AS s FROM (
  SELECT model, regime, v.horizon, response, {_IGRP} AS g, sum(value * value) AS n FROM irf, (VALUES (12), (24)) AS v(horizon) WHERE h <= v.horizon GROUP BY 1, 2, 3, 4, 5) a) b GROUP BY 1, 2, 3, 4"""


def _group_shares(spark, sf):
    groups = _groups(spark).withColumnRenamed("response", "impulse")
    return shares.group_shares(generalized_responses(spark, sf), groups)


@query("group_shares", sel("model regime horizon group", "share", f"({_GSH}) g"))
def group_shares(spark, sf):
    return _group_shares(spark, sf)


@query("trivial_shares", "SELECT DISTINCT uncertainty, regime, t, variable AS response, 'total' AS impulse, 1.0::DOUBLE AS fevd_share FROM delta")
def trivial_shares(spark, sf):
    return shares.trivial_shares(I.deltas(spark, sf))


# Shares of the models as index tables: a study per pair of series, proxy per driver, regime initial.
def _proxy_table(df, value):
    return df.select(
        F.split_part("model", F.lit(":"), F.lit(2)).alias("pair"), F.when(F.col("model").startswith("vol"), "vxo_vix").otherwise("jln").alias("proxy"),
        F.upper(F.substring("regime", 1, 1)).alias("regime"), "group", *value)


_PX = "CASE WHEN model LIKE 'vol%' THEN 'vxo_vix' ELSE 'jln' END"
cte("pshare", f"""SELECT {_PX} AS proxy, upper(left(regime, 1)) AS regime, split_part(model, ':', 2) AS pair, "group", horizon, share FROM ({_GSH}) g""")


@query("share_wedge", """
SELECT pair, "group", round(max(CASE WHEN proxy = 'vxo_vix' AND regime = 'H' THEN share END) - max(CASE WHEN proxy = 'vxo_vix' AND regime = 'L' THEN share END)
  - max(CASE WHEN proxy = 'jln' AND regime = 'H' THEN share END) + max(CASE WHEN proxy = 'jln' AND regime = 'L' THEN share END), 6) + 0.0 AS value, 12 AS horizon FROM pshare WHERE horizon = 12 GROUP BY 1, 2""")
def share_wedge(spark, sf):
    """Difference in differences at the horizon nearest to ten."""
    return shares.share_wedge(_proxy_table(_group_shares(spark, sf), ["horizon", "share"]), 10, keys=["pair", "group"])
