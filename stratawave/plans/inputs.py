"""Inputs of the queries, derived from the given tables.

The raw tables become calendar panels here.  Values are rounded once, so every later
comparison with a threshold is reproducible whatever the order of summation was.
Where several steps read one derived table, its lineage is cut by a checkpoint, so the
raw rows are read once and a lost executor costs a file read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.operators import fit, series
from stratawave.plans.registry import cte
from stratawave.schemas import SCENARIO_SPEC
from stratawave.session import cut_lineage
from stratawave.sources.readers import read_table
from stratawave.sources.specs import with_defaults

#: Means of few amounts often end exactly halfway between two rounded values; this
#: moves them off the tie, so that every engine rounds them the same way.
NUDGE = 1.7e-7

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def unit_prices(spark: SparkSession, sf: str, label: str = "p_type", unit: str = "month") -> DataFrame:
    """Mean unit price per label and calendar bucket: ``(series, date, price)``.

    Three columns of the lines and two of the parts are read.  Spark broadcasts the
    parts if they are small; else the lines are shuffled once by part, where adaptive
    execution splits a part with very many lines.  The sums per label and bucket
    combine on the map side, so the second shuffle carries only partial sums.
    """
    lines = read_table(spark, sf, "lineitem").select(
        "l_partkey", F.date_trunc(unit, "l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
    parts = read_table(spark, sf, "part").select("p_partkey", F.col(label).alias("series"))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("series", "date").agg(
        F.round(F.sum("price") / F.count("*"), 6).alias("price")
    )


cte("prices", """
SELECT p_type AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  round(sum(l_extendedprice / l_quantity) / count(*), 6) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
cte("brands", """
SELECT p_brand AS series, CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
  round(sum(l_extendedprice / l_quantity) / count(*), 6) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")
cte("weekly", """
SELECT p_type AS series, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
  round(sum(l_extendedprice / l_quantity) / count(*), 6) AS price
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""")


def indices(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """Two index series from the order values: level (``vol``) and spread (``macro``)."""
    orders = read_table(spark, sf, "orders").select(
        F.date_trunc(unit, "o_orderdate").cast("date").alias("date"), "o_totalprice"
    )
    both = orders.groupBy("date").agg(F.avg("o_totalprice").alias("vol"), F.stddev_samp("o_totalprice").alias("macro"))
    return both.unpivot(["date"], ["vol", "macro"], "index", "value").select("index", "date", F.round(F.col("value") + NUDGE, 4).alias("value"))


for _name, _unit in (("idx", "month"), ("widx", "week")):
    cte(_name, f"""
SELECT 'vol' AS "index", CAST(date_trunc('{_unit}', o_orderdate) AS DATE) AS date, round(avg(o_totalprice) + {NUDGE}, 4) AS value
FROM orders GROUP BY 2
UNION ALL
SELECT 'macro', CAST(date_trunc('{_unit}', o_orderdate) AS DATE), round(stddev_samp(o_totalprice) + {NUDGE}, 4) FROM orders GROUP BY 2""")


def gappy_brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brand prices with holes: a month whose number plus the brand's number is a multiple
    of seven has no price."""
    prices = unit_prices(spark, sf, "p_brand")
    brand = F.regexp_extract("series", r"(\d+)", 1).cast("int")
    return prices.withColumn("price", F.when((F.month("date") + brand) % 7 != 0, F.col("price")))


cte("gappy", """
SELECT series, date, CASE WHEN (month(date) + CAST(regexp_extract(series, '(\\d+)', 1) AS INTEGER)) % 7 <> 0 THEN price END AS price
FROM brands""")


def type_returns(spark: SparkSession, sf: str) -> DataFrame:
    return series.panel_returns(unit_prices(spark, sf))


cte("ret", """
SELECT series, date, price, ln(price) AS ln_price,
  CASE WHEN lag(price) OVER w > 0 AND price > 0 THEN ln(price / lag(price) OVER w) END AS ret
FROM prices WINDOW w AS (PARTITION BY series ORDER BY date)""")
cte("bret", """
SELECT series, date, price,
  CASE WHEN lag(price) OVER w > 0 AND price > 0 THEN ln(price / lag(price) OVER w) END AS ret
FROM gappy WINDOW w AS (PARTITION BY series ORDER BY date)""")
cte("fret", """
SELECT series, date, price,
  CASE WHEN lag(price) OVER w > 0 AND price > 0 THEN ln(price / lag(price) OVER w) END AS ret
FROM brands WINDOW w AS (PARTITION BY series ORDER BY date)""")
cte("wret", """
SELECT series, date, CASE WHEN lag(price) OVER w > 0 AND price > 0 THEN ln(price / lag(price) OVER w) END AS ret
FROM weekly WINDOW w AS (PARTITION BY series ORDER BY date)""")


def weekly_events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").select(
        F.col("event_type").alias("index"), F.col("ts"), "value"
    )


# --------------------------------------------------------------- regime states

DELAY = 1


def smoothed(spark: SparkSession, sf: str, n: int = 3) -> DataFrame:
    return indices(spark, sf).withColumn("ma", F.round(series.moving_average("value", n, ["index"]), 4))


cte("smooth", """
SELECT "index", date, value,
  CASE WHEN count(value) OVER w = 3 THEN round(avg(value) OVER w, 4) END AS ma
FROM idx WINDOW w AS (PARTITION BY "index" ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")


def driver(spark: SparkSession, sf: str) -> DataFrame:
    """Smoothed and delayed index: ``(index, date, x)``, missing at the start."""
    return smoothed(spark, sf).select("index", "date", series.delay("ma", DELAY, ["index"]).alias("x"))


cte("driver", """
SELECT "index", date, lag(ma, 1) OVER (PARTITION BY "index" ORDER BY date) AS x FROM smooth""")


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return driver(spark, sf).groupBy("index").agg(F.median("x").alias("theta"))


cte("theta", """SELECT "index", quantile_cont(x, 0.5) AS theta FROM driver WHERE x IS NOT NULL GROUP BY 1""")


def states(spark: SparkSession, sf: str) -> DataFrame:
    """State path per index: ``(index, date, x, theta, state)``."""
    from stratawave.operators.states import state_from_threshold

    # The median over the path itself: the orders are read once.
    joined = driver(spark, sf).withColumn("theta", F.median("x").over(series.whole(["index"])))
    return joined.withColumn("state", state_from_threshold(F.col("x"), F.col("theta")))


cte("states", """
SELECT "index", date, x, theta, CASE WHEN x IS NULL THEN NULL WHEN x <= theta THEN 1 ELSE 2 END AS state
FROM driver JOIN theta USING ("index")""")


# ---------------------------------------------------------------------- models

PAIRS = (("ECONOMY", "LARGE"), ("MEDIUM", "PROMO"), ("SMALL", "STANDARD"))
MODELS = [(f"{d}:{a}+{b}", d, a, b) for d in ("vol", "macro") for a, b in PAIRS]


def pair_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Six models: pairs of weekly series, each with the two drivers."""
    returns = series.log_return(unit_prices(spark, sf, unit="week"), out="ret")
    members = spark.createDataFrame(
        [(m, s, i) for m, _, a, b in MODELS for i, s in enumerate((a, b))], "model string, series string, pos int"
    )
    drivers = spark.createDataFrame([(m, d) for m, d, _, _ in MODELS], "model string, index string")
    q = indices(spark, sf, "week").join(drivers, "index").select("model", "date", F.col("value").alias("q"))
    return cut_lineage(fit.model_vectors(returns, members, q))


_values = ", ".join(f"('{m}', '{d}', '{a}', '{b}')" for m, d, a, b in MODELS)
cte("pairs", f"SELECT * FROM (VALUES {_values}) AS v(model, drv, s1, s2)")
cte("mrows", """
SELECT model, s1, s2, a.date, a.ret AS r1, b.ret AS r2, d.value AS q
FROM pairs JOIN wret a ON a.series = s1 JOIN wret b ON b.series = s2 AND b.date = a.date
JOIN widx d ON d."index" = drv AND d.date = a.date
WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL AND d.value IS NOT NULL""")
cte("mz", """
SELECT model, s1, s2, date, q, row_number() OVER (PARTITION BY model ORDER BY date) AS t,
  (r1 - avg(r1) OVER m) / stddev_samp(r1) OVER m AS y1, (r2 - avg(r2) OVER m) / stddev_samp(r2) OVER m AS y2
FROM mrows WINDOW m AS (PARTITION BY model)""")
cte("dz", """
SELECT * FROM (SELECT *, lag(y1) OVER w AS x1, lag(y2) OVER w AS x2, lag(q, 1) OVER w AS q1, lag(q, 2) OVER w AS q2
FROM mz WINDOW w AS (PARTITION BY model ORDER BY date)) s WHERE t > 1""")


def median_spec(vectors: DataFrame, delay: int = DELAY) -> DataFrame:
    """Given split: order 1, delay 1, the median of the driver as threshold."""
    return vectors.groupBy("model").agg(F.median("q").alias("theta")).select(
        "model", F.lit(1).alias("p"), F.lit(delay).alias("delay"), "theta"
    )


cte("mtheta", "SELECT model, quantile_cont(q, 0.5) AS theta FROM mz GROUP BY 1")
cte("srows", """
SELECT dz.*, CASE WHEN q1 <= theta THEN 'low' ELSE 'high' END AS regime
FROM dz JOIN mtheta USING (model) WHERE q1 IS NOT NULL""")
cte("prows", "SELECT *, 'pooled' AS regime FROM dz")


def _moments(source: str) -> str:
    pairs = ["x1,x1", "x1,x2", "x2,x2", "x1,y1", "x1,y2", "x2,y1", "x2,y2", "y1,y1", "y1,y2", "y2,y2"]
    cov = ", ".join(f"covar_pop({p}) AS {p.replace(',', '')}" for p in pairs)
    return f"""SELECT model, regime, any_value(s1) AS s1, any_value(s2) AS s2, count(*) AS n,
  avg(x1) AS mx1, avg(x2) AS mx2, avg(y1) AS my1, avg(y2) AS my2, {cov} FROM {source} GROUP BY 1, 2"""


def _solved(source: str) -> str:
    """Two regressors with intercept in closed form, from centred moments."""
    return f"""SELECT *, n * (y1y1 - b11 * x1y1 - b12 * x2y1) AS rss1, n * (y2y2 - b21 * x1y2 - b22 * x2y2) AS rss2,
  n * (y1y2 - b11 * x1y2 - b12 * x2y2) AS rss12, my1 - b11 * mx1 - b12 * mx2 AS c1, my2 - b21 * mx1 - b22 * mx2 AS c2
FROM (SELECT *, (x1y1 * x2x2 - x2y1 * x1x2) / det AS b11, (x2y1 * x1x1 - x1y1 * x1x2) / det AS b12,
  (x1y2 * x2x2 - x2y2 * x1x2) / det AS b21, (x2y2 * x1x1 - x1y2 * x1x2) / det AS b22
FROM (SELECT *, x1x1 * x2x2 - x1x2 * x1x2 AS det FROM ({_moments(source)}) m) d) s"""


cte("sfit", f"""SELECT *, rss1 / (n - 1) AS g11, rss12 / (n - 1) AS g12, rss2 / (n - 1) AS g22 FROM ({_solved("srows")}) f""")
cte("pfit", f"""SELECT *, rss1 / (n - 3) AS g11, rss12 / (n - 3) AS g12, rss2 / (n - 3) AS g22 FROM ({_solved("prows")}) f""")


# ------------------------------------------------------------ scenario inputs

REGIME_DECAY = {"low": 0.5, "high": 0.8, "combined": 0.65}
INDEX_SCALE = {"vol": 1.0, "macro": 1.25}
STEPS = 12


def type_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly return vector of the six types, complete months only."""
    returns = type_returns(spark, sf).where(F.col("ret").isNotNull())
    rows = returns.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("series", "ret"))).alias("v"))
    return rows.where(F.size("v") == len(TYPES)).select(
        F.lit("types").alias("model"), "date", F.transform("v", lambda s: s["ret"]).alias("y")
    )


def kernels(spark: SparkSession, sf: str) -> DataFrame:
    """Response kernels per index and regime from the covariances of the returns:
    the regression slope of one series on another, fading with the horizon."""
    cov = fit.covariances(type_vectors(spark, sf))
    names = F.array(*[F.lit(t) for t in TYPES])
    var = cov.where(F.col("i") == F.col("j")).select("j", F.col("value").alias("_v"))
    slope = cov.join(var, "j").select(
        F.get(names, "i").alias("response"), F.get(names, "j").alias("impulse"), (F.col("value") / F.col("_v")).alias("_a")
    )
    axes = F.array(*[
        F.struct(F.lit(u).alias("uncertainty"), F.lit(r).alias("regime"), F.lit(s).alias("_s"), F.lit(d).alias("_d"))
        for u, s in INDEX_SCALE.items() for r, d in REGIME_DECAY.items()
    ])
    faded = slope.select("response", "impulse", "_a", F.inline(axes)).withColumn(
        "h", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1)))
    ).select("uncertainty", "regime", "impulse", "response", "h",
             F.round(F.col("_a") * F.col("_s") * F.pow("_d", "h") + NUDGE / 100, 6).alias("value"))
    return cut_lineage(faded)


_axes = ", ".join(f"('{u}', '{r}', {s}::DOUBLE, {d}::DOUBLE)" for u, s in INDEX_SCALE.items() for r, d in REGIME_DECAY.items())
cte("cret", f"""SELECT series, date, ret FROM ret WHERE ret IS NOT NULL AND date IN
  (SELECT date FROM ret WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = {len(TYPES)})""")
cte("slopes", """
SELECT a.series AS response, b.series AS impulse, covar_samp(a.ret, b.ret) / var_samp(b.ret) AS a
FROM cret a JOIN cret b ON a.date = b.date GROUP BY 1, 2""")
cte("kern", f"""
SELECT u AS uncertainty, r AS regime, impulse, response, CAST(h AS INTEGER) AS h,
  round(a * s * power(d, h) + {NUDGE / 100}, 6) AS value
FROM slopes, (VALUES {_axes}) AS x(u, r, s, d), (SELECT unnest(range(0, {STEPS})) AS h) hh""")

SPECS = [
    # name, type, regime, horizon, shocks, schedule, impulse, size, units, scenarios
    ("econ_drop", "path", "combined", 12, {"ECONOMY": -2.0}, [], None, None, None, []),
    ("mixed_push", "path", "all", 10, {"LARGE": 0.5}, [("LARGE", 1, 1, 1.0), ("MEDIUM", 2, 4, 0.25)], None, None, None, []),
    ("late_promo", "path", "high", 12, {}, [("PROMO", 3, 20, 1.5)], None, None, None, []),
    ("resp_small", "girf", "all", 12, {}, [], "SMALL", 2.0, "sigma", []),
    ("resp_pair", "girf", "low", 6, {}, [], None, None, None,
     [("pair_a", "STANDARD", 1.0, "sigma"), ("pair_b", "ECONOMY", 0.01, "abs")]),
]


def specs(spark: SparkSession) -> DataFrame:
    return with_defaults(spark.createDataFrame(SPECS, SCENARIO_SPEC))


def shock_sigma(spark: SparkSession, sf: str) -> DataFrame:
    """Return sd of each type, the same for both indices: ``(uncertainty, impulse, sigma)``."""
    sd = type_returns(spark, sf).groupBy(F.col("series").alias("impulse")).agg(F.round(F.stddev_samp("ret"), 8).alias("sigma"))
    return sd.withColumn("uncertainty", F.explode(F.array(*[F.lit(u) for u in INDEX_SCALE])))


cte("sigma", "SELECT series AS impulse, round(stddev_samp(ret), 8) AS sigma FROM ret GROUP BY 1")

_path = [s for s in SPECS if s[1] == "path"]
_sched = ", ".join(f"('{s[0]}', {s[3]}, '{i}', {a}, {b}, {z}::DOUBLE)" for s in _path for i, a, b, z in s[5])
_shock = ", ".join(f"('{s[0]}', {s[3]}, '{i}', {z}::DOUBLE)" for s in _path for i, z in s[4].items())
_reg = ", ".join(
    f"('{s[0]}', {s[3]}, '{r}')" for s in _path for r in (REGIME_DECAY if s[2] == "all" else [s[2]])
)
_girf = ", ".join(
    f"('{n}', {s[3]}, '{r}', '{i}', {z}::DOUBLE, '{u}')"
    for s in SPECS if s[1] == "girf"
    for n, i, z, u in (s[9] or [(s[0], s[6], s[7], s[8])])
    for r in (REGIME_DECAY if s[2] == "all" else [s[2]])
)
cte("ugrid", f"""
SELECT scenario, horizon, CAST(t AS INTEGER) AS t, impulse, sum(size) AS u FROM (
  SELECT scenario, horizon, impulse, size, unnest(range(greatest(1, t0), least(horizon, t1) + 1)) AS t
  FROM (VALUES {_sched}) AS v(scenario, horizon, impulse, t0, t1, size)
  UNION ALL SELECT scenario, horizon, impulse, size, 1 FROM (VALUES {_shock}) AS v(scenario, horizon, impulse, size)
) g GROUP BY 1, 2, 3, 4""")
cte("effects", """
SELECT uncertainty, scenario, regime, response AS variable, t + h AS t, sum(u * value) AS value
FROM ugrid JOIN kern USING (impulse) WHERE t + h <= horizon GROUP BY 1, 2, 3, 4, 5""")
cte("shocked", f"""
SELECT g.uncertainty, g.scenario, g.regime, g.variable, g.t, round(coalesce(e.value, 0), 8) + 0.0 AS value
FROM (SELECT uncertainty, scenario, regime, variable, unnest(range(1, horizon + 1)) AS t
      FROM (SELECT DISTINCT uncertainty, regime, response AS variable FROM kern) a
      JOIN (VALUES {_reg}) AS v(scenario, horizon, regime) USING (regime)) g
LEFT JOIN effects e USING (uncertainty, scenario, regime, variable, t)
UNION ALL
SELECT uncertainty, scenario, regime, response, h + 1,
  round(size / CASE WHEN units = 'abs' AND sigma > 0 THEN sigma ELSE 1 END * value, 8) + 0.0
FROM (VALUES {_girf}) AS v(scenario, horizon, regime, impulse, size, units)
JOIN kern USING (regime, impulse) JOIN sigma USING (impulse) WHERE h < horizon""")
cte("tidy", """
SELECT *, FALSE AS is_baseline FROM shocked
UNION ALL SELECT uncertainty, scenario, regime, variable, t, 0.0, TRUE FROM shocked""")


def tidy(spark: SparkSession, sf: str, kernel: DataFrame | None = None) -> DataFrame:
    from stratawave.operators.scenarios import run_scenarios

    out = run_scenarios(specs(spark), kernel or kernels(spark, sf), shock_sigma(spark, sf))
    return cut_lineage(out.withColumn("value", F.round("value", 8)))


# ------------------------------------------------- decomposition inputs


def shares(spark: SparkSession, sf: str, kernel: DataFrame | None = None) -> DataFrame:
    """Variance shares of every index, regime and step."""
    from stratawave.operators.shares import shares_per_step

    k = kernel or kernels(spark, sf)
    variables = k.select("uncertainty", F.col("response").alias("variable")).distinct()
    return shares_per_step(k, variables, tuple(REGIME_DECAY))


cte("cumsq", """
SELECT uncertainty, regime, response, impulse, h + 1 AS t,
  sum(value * value) OVER (PARTITION BY uncertainty, regime, response, impulse ORDER BY h) AS num
FROM kern""")
cte("fevd", """
SELECT uncertainty, regime, response, impulse, t,
  num / greatest(sum(num) OVER (PARTITION BY uncertainty, regime, response, t), 2.220446049250313e-16) AS fevd_share
FROM cumsq""")
cte("delta", """
SELECT uncertainty, scenario, regime, variable, t, sum(value) AS delta FROM shocked GROUP BY 1, 2, 3, 4, 5""")
cte("contrib", """
SELECT d.uncertainty, d.scenario, f.impulse AS shock_id, d.regime, d.variable, d.t,
  round(d.delta * f.fevd_share, 9) AS contribution
FROM delta d JOIN fevd f ON f.uncertainty = d.uncertainty AND f.regime = d.regime AND f.response = d.variable AND f.t = d.t""")


def deltas(spark: SparkSession, sf: str, paths: DataFrame | None = None) -> DataFrame:
    from stratawave.operators.contrib import delta_table, extract_shocked

    t = paths or tidy(spark, sf)
    zero = t.where("is_baseline").select("uncertainty", "regime", "variable", "t", "value").distinct()
    return delta_table(extract_shocked(t), zero)


def decomposition(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Deltas and their contributions by variance share, from one set of kernels.

    Contributions are rounded so that rankings do not depend on the last bit.
    """
    from stratawave.operators.contrib import by_shares

    k = kernels(spark, sf)
    delta = deltas(spark, sf, tidy(spark, sf, k))
    contrib = by_shares(delta, shares(spark, sf, k)).withColumn("contribution", F.round("contribution", 9))
    return delta, contrib


def contributions(spark: SparkSession, sf: str) -> DataFrame:
    return decomposition(spark, sf)[1]
