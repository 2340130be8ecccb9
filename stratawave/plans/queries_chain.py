"""Chained stages on fitted models: store, regime dynamics, responses, kernels, scenarios, contributions.

The pair models are fitted once per query, saved under a version and read back by model id; everything after
that comes from the stored fits.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from stratawave.operators import fit
from stratawave.plans import inputs as I
from stratawave.plans import pipeline
from stratawave.plans.queries_models import H, _pooled, _split
from stratawave.plans.registry import CTES, ORACLES, cte, query, sel
from stratawave.session import checkpoint_folder, cut_lineage
from stratawave.sources.models import load_models, save_models

#: Steps of the fitted kernels.
STEPS = 12


def _folder(spark) -> str:
    return f"{checkpoint_folder(spark)}/models-{uuid.uuid4().hex}"


def stored_fits(spark, sf):
    """The fits of the pair models as a later stage reads them."""
    fits, path = _split(spark, sf)[1], _folder(spark)
    save_models(fits, path, "v0001")
    return load_models(spark, path).drop("version").select(*fits.columns)


@query("stage_model_store", """
SELECT model, 'v0001' AS version, regime, n AS n_obs, round(rss1, 5) + 0.0 AS rss_first FROM sfit WHERE model LIKE 'macro:%'
UNION ALL SELECT model, 'v0002', 'pooled', n, round(rss1, 5) + 0.0 FROM pfit WHERE model LIKE 'vol:%'""", digits=5)
def stage_model_store(spark, sf):
    """Two versions: fits per regime of all models, then pooled fits of those of one index; the newest of each model is read."""
    vectors, path = I.pair_vectors(spark, sf), _folder(spark)
    save_models(_split(spark, sf, vectors)[1], path, "v0001")
    save_models(_pooled(spark, sf, vectors)[1].where(F.col("model").startswith("vol:")), path, "v0002")
    return load_models(spark, path).select("model", "version", "regime", F.col("n_obs").cast("long").alias("n_obs"), F.get("rss", F.lit(0)).alias("rss_first"))


@query("stage_regime_dynamics", """
WITH b AS (SELECT model, regime, (regime IS DISTINCT FROM lag(regime) OVER (PARTITION BY model ORDER BY date))::INT AS first FROM srows),
n AS (SELECT model, sum(CASE WHEN regime = 'low' THEN first ELSE 0 END)::BIGINT AS l, sum(CASE WHEN regime = 'high' THEN first ELSE 0 END)::BIGINT AS h FROM b GROUP BY 1)
SELECT model, nl AS n_low, nh AS n_high, l AS n_spells_low, h AS n_spells_high, round(rl, 6) + 0.0 AS rho_low, round(rh, 6) + 0.0 AS rho_high FROM sides JOIN n USING (model)""")
def stage_regime_dynamics(spark, sf):
    """State paths of the fitted models with their spells, transitions and the roots of the stored fits."""
    rows, fits = _split(spark, sf)
    path = rows.select("model", "date", F.when(F.col("regime") == "low", 1).otherwise(2).alias("state"))
    folder = _folder(spark)
    save_models(fits, folder, "v0001")
    roots = fit.stability(load_models(spark, folder).drop("version").select(*fits.columns))
    out = pipeline.regime_dynamics(path, roots=roots)["summary"]
    return out.select("model", "n_low", "n_high", "n_spells_low", "n_spells_high", "rho_low", "rho_high")


@query("stage_response_tables")
def stage_response_tables(spark, sf):
    """High minus low response curves of the stored fits."""
    groups = I.type_returns(spark, sf).select(F.col("series").alias("response"), F.col("series").alias("group")).distinct()
    return pipeline.response_tables(stored_fits(spark, sf), groups, H)["difference"]


ORACLES["stage_response_tables"] = ORACLES["regime_difference"]

cte("mkern", f"""
SELECT model AS uncertainty, regime, impulse, response, h::INTEGER AS h, value FROM sdirf WHERE h < {STEPS}
UNION ALL SELECT model, 'combined', impulse, response, h::INTEGER, avg(value) FROM sdirf WHERE h < {STEPS} GROUP BY 1, 3, 4, 5""")


def _fitted(name: str) -> str:
    """A table expression of the scenario chain over the fitted kernels."""
    return re.sub(r"\b(FROM|JOIN) (kern|effects|shocked|cumsq|delta|fevd)\b", r"\1 m\2", CTES[name])


for _name in ("effects", "shocked", "cumsq", "fevd", "delta"):
    cte(f"m{_name}", _fitted(_name))


def fitted_kernels(spark, sf):
    return cut_lineage(pipeline.scenario_kernels(stored_fits(spark, sf), STEPS, "sd"))


@query("stage_scenario_kernels", sel("uncertainty regime impulse response h", "value", "mkern"))
def stage_scenario_kernels(spark, sf):
    """Kernels of the stored fits, with the mean of both regimes."""
    return fitted_kernels(spark, sf)


def _run(spark, sf):
    kernels = fitted_kernels(spark, sf)
    sd = I.shock_sigma(spark, sf).select("impulse", "sigma").distinct()
    sigma = kernels.select("uncertainty", "impulse").distinct().join(sd, "impulse")
    return pipeline.scenario_run(I.specs(spark), kernels, sigma)


@query("stage_scenario_run", sel("uncertainty scenario regime variable t", "value", "mshocked"))
def stage_scenario_run(spark, sf):
    """Every scenario on every fitted model."""
    paths = _run(spark, sf)["paths"].where(~F.col("is_baseline"))
    return paths.select("uncertainty", "scenario", "regime", "variable", "t", F.round("value", 8).alias("value"))


@query("stage_scenario_contributions", """
SELECT d.uncertainty, d.scenario, f.impulse AS shock_id, d.regime, d.variable, d.t, round(d.delta * f.fevd_share, 6) + 0.0 AS contribution
FROM mdelta d JOIN mfevd f ON f.uncertainty = d.uncertainty AND f.regime = d.regime AND f.response = d.variable AND f.t = d.t""")
def stage_scenario_contributions(spark, sf):
    """Scenario effects split by the variance shares of the fitted kernels."""
    return _run(spark, sf)["contrib"].drop("method")
