"""Queries that run whole stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratawave.operators import series
from stratawave.plans import inputs as I
from stratawave.plans import pipeline
from stratawave.plans.registry import cte, query
from stratawave.session import cut_lineage

cte("stage_panel", """
SELECT regexp_replace(lower(series), '[^a-z0-9]+', '_', 'g') AS series_id, date, price,
  CASE WHEN lag(price) OVER w > 0 THEN ln(price / lag(price) OVER w) END AS ret
FROM (SELECT * FROM brands WHERE series IN (SELECT series FROM brands GROUP BY 1 HAVING count(price) >= 60)) g WINDOW w AS (PARTITION BY series ORDER BY date)""")
cte("stage_merged", """
SELECT s."index", p.*, i.value FROM stage_panel p CROSS JOIN (SELECT "index", min(date) AS lo, max(date) AS hi FROM idx GROUP BY 1) s
LEFT JOIN idx i ON i."index" = s."index" AND i.date = p.date WHERE p.date >= s.lo AND p.date <= s.hi AND p.date >= DATE '1995-06-01'""")


def _input(spark, sf, part):
    """One part of the model input, for each of the indices."""
    panel = cut_lineage(pipeline.panel(I.unit_prices(spark, sf, "p_brand"), min_obs=60))
    both = cut_lineage(I.indices(spark, sf))
    tables = [pipeline.model_input(panel, both.where(F.col("index") == name), start="1995-06-01")[part].withColumn("index", F.lit(name))
              for name in I.INDEX_SCALE]
    return tables[0].unionByName(tables[1])


@query("stage_model_input", """
SELECT "index", series_id, date, round(price, 6) + 0.0 AS price, round(ret, 6) + 0.0 AS ret, round(value, 4) + 0.0 AS value FROM stage_merged WHERE ret IS NOT NULL AND value IS NOT NULL""")
def stage_model_input(spark, sf):
    """Long prices to the rows a model can use, with each index."""
    return _input(spark, sf, "rows").select("index", "series_id", "date", "price", "ret", F.round("value", 4).alias("value"))


@query("stage_input_coverage", """
SELECT "index", series_id, round(avg((ret IS NOT NULL AND value IS NOT NULL)::INT), 6) + 0.0 AS coverage,
  CASE WHEN sum((ret IS NULL)::INT) > 0 AND sum((ret IS NULL)::INT) >= sum((ret IS NOT NULL AND value IS NULL)::INT) THEN 'ret' WHEN sum((value IS NULL)::INT) > 0 THEN 'value' END AS top_reason
FROM stage_merged GROUP BY 1, 2""")
def stage_input_coverage(spark, sf):
    return _input(spark, sf, "coverage")


@query("stage_estimated_models")
def stage_estimated_models(spark, sf):
    """Search, fit and diagnose three-series models with up to two lags."""
    returns = series.log_return(I.unit_prices(spark, sf, unit="week"), out="ret")
    members = spark.createDataFrame(
        [(f"{d}:{i}", s, j) for d in ("vol", "macro") for i in (0, 1) for j, s in enumerate(I.TYPES[3 * i:3 * i + 3])],
        "model string, series string, pos int")
    q = I.indices(spark, sf, "week").select("index", "date", F.col("value").alias("q"))
    drivers = q.withColumn("model", F.explode(F.array(F.concat("index", F.lit(":0")), F.concat("index", F.lit(":1"))))).select("model", "date", "q")
    config = pipeline.SearchConfig(lags=(1, 2), delays=(1, 2), ngrid=40, smooth=3)
    return pipeline.estimate(returns, members, drivers, config)["registry"]
