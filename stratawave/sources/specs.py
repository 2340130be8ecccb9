"""Scenario specs as a table, and their validation as issue rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratawave.schemas import SCENARIO_SPEC

REGIMES = ("combined", "low", "high")


def read_specs(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    reader = spark.read.schema(SCENARIO_SPEC)
    if fmt == "json":
        reader = reader.option("multiLine", True)
    return with_defaults(reader.format(fmt).load(path))


def with_defaults(specs: DataFrame, horizon: int = 48) -> DataFrame:
    """Type, regime and horizon defaults; a horizon that is given stays."""
    return specs.withColumns({
        "type": F.lower(F.coalesce("type", F.lit("path"))),
        "regime": F.lower(F.coalesce("regime", F.lit("combined"))),
        "horizon": F.coalesce("horizon", F.lit(horizon)),
    })


def shock_names(specs: DataFrame) -> DataFrame:
    """Every impulse name a spec uses: ``(name, source, impulse)``, in one pass."""
    def named(source: str, names: Column) -> Column:
        return F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: F.struct(
            F.lit(source).alias("source"), n.alias("impulse")
        ))

    used = F.concat(
        named("shocks", F.map_keys("shocks")), named("schedule", F.col("schedule.impulse")),
        named("scenarios", F.col("scenarios.impulse")), named("impulse", F.array("impulse")),
    )
    return specs.select("name", F.inline(used)).where(F.col("impulse").isNotNull())


def spec_issues(specs: DataFrame, variables: DataFrame) -> DataFrame:
    """Validation of all specs in one job: ``(name, level, what)``.

    ``variables`` has one column ``variable`` with the model's variables.
    """
    name = F.coalesce("name", F.lit("?")).alias("name")
    checks = [
        (F.coalesce(F.length("name"), F.lit(0)) == 0, "error", "missing name"),
        (F.col("horizon") < 1, "error", "horizon below 1"),
        (~F.lower("regime").isin(*REGIMES, "all", "*"), "warning", "unknown regime"),
        (F.exists(F.map_keys("shocks"), lambda k: F.length(k) == 0), "error", "shock without a name"),
        (F.exists(F.map_values("shocks"), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))),
         "error", "shock value not finite"),
        (F.exists("schedule", lambda s: s["impulse"].isNull()), "error", "schedule item without impulse"),
        ((F.lower("type") == "girf") & F.col("impulse").isNull()
         & (F.coalesce(F.size("scenarios"), F.lit(0)) < 1), "error", "response scenario without impulse"),
    ]
    found = F.array(*[
        F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(what).alias("what"))) for cond, level, what in checks
    ])
    own = specs.select(name, F.inline(F.filter(found, lambda x: x.isNotNull())))
    known = variables.select(F.col("variable").alias("impulse")).distinct()
    unknown = shock_names(specs).join(known, "impulse", "left_anti").select(
        name, F.lit("error").alias("level"),
        F.concat(F.col("source"), F.lit(" uses unknown variable "), F.col("impulse")).alias("what"),
    )
    return own.unionByName(unknown.distinct())
