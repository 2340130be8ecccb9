"""Stages of a run, chained on simulated models and the smallest tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.plans import inputs, pipeline
from stratawave.schemas import PANEL, SCENARIO_SPEC, drift
from stratawave.session import cut_lineage
from stratawave.sources import specs, writers


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(11)
    n = 240
    q, y = rng.normal(size=n), np.zeros((n, 2))
    for t in range(1, n):
        y[t] = (0.5 if q[t - 1] <= 0 else -0.4) * y[t - 1] + rng.normal(size=2)
    day = [dt.date(2001, 1, 1) + dt.timedelta(days=30 * t) for t in range(n)]
    returns = spark.createDataFrame([(s, day[t], float(y[t, i])) for i, s in enumerate("ab") for t in range(n)], "series string, date date, ret double")
    members = spark.createDataFrame([("m", "a", 0), ("m", "b", 1)], "model string, series string, pos int")
    drivers = spark.createDataFrame([("m", day[t], float(q[t])) for t in range(n)], "model string, date date, q double")
    return pipeline.estimate(returns, members, drivers, pipeline.SearchConfig(lags=(1, 2), delays=(1,), ngrid=30, smooth=1))


def test_estimate_finds_the_split(model):
    r = model["registry"].first()
    assert (r["p"], r["delay"]) == (1, 1) and abs(r["theta"]) < 0.4 and r["low_stable"] and r["high_stable"]
    assert model["failed"].count() == 0
    assert model["coefficients"].count() == 2 * 2 * 3


def test_dynamics_and_responses(spark, model):
    out = pipeline.regime_dynamics(model["states"], draws=100)
    s = out["summary"].first()
    assert s["n_low"] + s["n_high"] == model["rows"].count()
    assert out["bootstrap"].count() == 2
    groups = spark.createDataFrame([("a", "A"), ("b", "B")], "response string, group string")
    tables = pipeline.response_tables(model["fits"], groups, 24)
    total = tables["group_shares"].groupBy("model", "regime", "horizon").agg(F.sum("share").alias("s")).collect()
    assert total and all(abs(r["s"] - 1) < 1e-9 for r in total)


def test_scenarios_add_up(spark, model):
    kernels = pipeline.scenario_kernels(model["fits"], 8)
    spec = specs.with_defaults(spark.createDataFrame(
        [("s", "path", "all", 8, {"a": 1.0}, [("b", 2, 3, -0.5)], None, None, None, [])], SCENARIO_SPEC))
    out = pipeline.scenario_run(spec, kernels)
    assert out["mass"].first()["ok"]
    assert {r["regime"] for r in out["paths"].select("regime").distinct().collect()} == {"low", "high", "combined"}
    assert out["issues"].where("n_bad > 0").count() == 0


def test_panel_has_the_declared_schema(spark, sf, tmp_path):
    table = pipeline.panel(inputs.unit_prices(spark, sf), ["economy", "SMALL"], min_obs=10)
    assert drift(table.schema, PANEL) == []
    pipeline.write({"panel": table}, str(tmp_path))
    back = spark.read.parquet(str(tmp_path / "panel"))
    assert back.select("series_id").distinct().count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        writers.save(table, str(tmp_path / "panel"), overwrite=False)


def test_content_hash_ignores_order(spark):
    a = spark.range(100).withColumn("v", F.col("id") * 2)
    assert writers.content_hash(a).first() == writers.content_hash(a.orderBy(F.col("id").desc()).repartition(7)).first()
    assert writers.content_hash(a).first() != writers.content_hash(a.withColumn("v", F.col("v") + 1)).first()


def test_checkpoint_uses_the_named_folder(spark):
    assert cut_lineage(spark.range(5)).count() == 5
    assert spark.sparkContext.getCheckpointDir()
