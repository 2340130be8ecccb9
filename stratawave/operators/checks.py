"""Assertions as data: every check is a row ``(check, level, n_bad)``.

All checks of a table that need one pass share one aggregation; the ones about
keys or neighbours add one grouped step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counted(df: DataFrame, rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """Run aggregate rules in one pass.  A rule is (level, number of bad cases)."""
    one = df.agg(*[expr.cast("long").alias(name) for name, (_, expr) in rules.items()])
    rows = F.array(*[
        F.struct(F.lit(name).alias("check"), F.lit(level).alias("level"), F.coalesce(F.col(name), F.lit(0)).alias("n_bad"))
        for name, (level, _) in rules.items()
    ])
    return one.select(F.inline(rows))


def bad(cond: Column) -> Column:
    return F.count_if(cond)


def one_if(cond: Column) -> Column:
    """1 when an aggregate condition holds."""
    return F.when(cond, 1).otherwise(0)


def key_duplicates(df: DataFrame, keys: Sequence[str], name: str = "duplicate_keys") -> DataFrame:
    extra = df.groupBy(*keys).count().where(F.col("count") > 1)
    return counted(extra, {name: ("error", F.count("*"))})


def parsed_checks(df: DataFrame, today: Column | None = None, min_rows: int = 1000, min_series: int = 20) -> DataFrame:
    """Checks of a long price table."""
    now = today if today is not None else F.current_date()
    return counted(df, {
        "few_rows": ("error", one_if(F.count("*") < min_rows)),
        "few_series": ("error", one_if(F.count_distinct("series") < min_series)),
        "null_date": ("error", bad(F.col("date").isNull())),
        "null_series": ("error", bad(F.col("series").isNull())),
        "null_price": ("error", bad(F.col("price").isNull())),
        "early_date": ("error", bad(F.col("date") < F.lit("1960-01-01").cast("date"))),
        "future_date": ("error", bad(F.col("date") > F.date_add(now, 60))),
    })


def panel_checks(df: DataFrame) -> DataFrame:
    """Checks of the canonical panel: unique key, at most one NULL return per series."""
    per_series = df.groupBy("series_id").agg(
        bad(F.col("ret").isNull()).alias("na_ret"), bad(F.col("vol_proxy").isNull()).alias("na_vol")
    )
    nulls = counted(per_series, {
        "series_with_null_returns": ("warning", bad(F.col("na_ret") > 1)),
        "series_with_null_volatility": ("warning", bad(F.col("na_vol") > 1)),
    })
    return key_duplicates(df, ["series_id", "date"]).unionByName(nulls)


def index_checks(df: DataFrame, allow_negative: bool = False, min_rows: int = 10) -> DataFrame:
    """Checks per index: ``(index, check, level, n_bad)``."""
    step = F.datediff("date", F.lag("date").over(W.partitionBy("index").orderBy("date")))
    q = F.percentile("value", F.array(F.lit(0.01), F.lit(0.99)))
    per = df.withColumn("_step", step).groupBy("index").agg(
        F.count("*").alias("n"),
        bad(F.col("_step") == 0).alias("duplicate_dates"),
        bad(F.col("value").isNull()).alias("null_values"),
        bad(F.abs("value") == float("inf")).alias("infinite_values"),
        bad(F.col("value") < 0).alias("negative_values"),
        F.stddev_samp("value").alias("sd"),
        F.median("_step").alias("freq"),
        F.min("date").alias("start"), F.max("date").alias("end"),
        F.collect_set("_step").alias("_steps"),
        q.alias("q"), F.max(F.abs("value")).alias("top"),
    )
    rules = [
        ("too_few_rows", "error", F.col("n") < min_rows),
        ("duplicate_dates", "error", F.col("duplicate_dates")),
        ("null_values", "error", F.col("null_values")),
        ("infinite_values", "error", F.col("infinite_values")),
        ("negative_values", "warning" if allow_negative else "error", F.col("negative_values")),
        ("near_constant", "warning", F.col("sd") < 1e-6),
        ("irregular_steps", "warning", F.size("_steps") > 1),
        ("spikes", "warning", F.col("top") / (F.col("q")[1] - F.col("q")[0] + 1e-5) > 10),
        ("early_start", "warning", F.year("start") < 1980),
    ]
    rows = F.array(*[
        F.struct(F.lit(n).alias("check"), F.lit(lv).alias("level"), F.coalesce(e.cast("long"), F.lit(0)).alias("n_bad"))
        for n, lv, e in rules
    ])
    return per.select("index", F.inline(rows))


def merged_checks(df: DataFrame, value: str = "value", floor: float = 0.40) -> DataFrame:
    per = df.groupBy("series").agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage"))
    low = counted(per, {"series_with_low_coverage": ("warning", bad(F.col("coverage") < floor))})
    return key_duplicates(df, ["series", "date"]).unionByName(low)


def frequency(df: DataFrame, keys: Sequence[str] = ("series",), date: str = "date") -> DataFrame:
    """Median day step with its label, modal step, and whether any step differs.

    Steps are counted per length first, so mode and gap flag work on a few rows.
    """
    step = F.datediff(date, F.lag(date).over(W.partitionBy(*keys).orderBy(date)))
    steps = df.select(*keys, step.alias("_step")).where(F.col("_step").isNotNull())
    per = steps.groupBy(*keys).agg(
        F.median("_step").alias("median_step"), F.count("*").alias("n_steps"), F.count_distinct("_step").alias("_kinds")
    )
    counts = steps.groupBy(*keys, "_step").count()
    mode = counts.groupBy(*keys).agg(F.min_by("_step", F.struct(-F.col("count"), F.col("_step"))).alias("mode_step"))
    whole = F.col("median_step").cast("int")
    label = (
        F.when(whole.between(28, 31), "monthly").when(whole.between(6, 8), "weekly").when(whole == 1, "daily")
        .otherwise(F.concat(whole.cast("string"), F.lit("-day interval")))
    )
    return per.join(mode, list(keys)).select(
        *keys, "n_steps", "median_step", label.alias("frequency"), "mode_step", (F.col("_kinds") > 1).alias("has_gaps")
    )


def spike_score(df: DataFrame, keys: Sequence[str] = ("index",), value: str = "value") -> DataFrame:
    """Largest absolute value over the spread between the 1 % and 99 % quantiles."""
    q = F.percentile(value, F.array(F.lit(0.01), F.lit(0.99)))
    return df.groupBy(*keys).agg(F.max(F.abs(value)).alias("_top"), q.alias("_q")).select(
        *keys, (F.col("_top") / (F.col("_q")[1] - F.col("_q")[0] + 1e-5)).alias("spike_score")
    ).withColumn("spiky", F.col("spike_score") > 10)


def input_issues(baseline: DataFrame, shocked: DataFrame) -> DataFrame:
    """Issues of a decomposition's inputs: ``(level, where, what, n_bad)``."""
    def whole_step(df: DataFrame, where: str) -> DataFrame:
        wrong = (F.col("t") < 0) | (F.abs(F.col("t") - F.round("t")) >= 1e-10) | F.col("t").isNull()
        return df.agg(bad(wrong).alias("n_bad")).select(
            F.lit("error").alias("level"), F.lit(where).alias("where"), F.lit("t not a whole non-negative number").alias("what"), "n_bad")

    def duplicates(df: DataFrame, where: str, keys: list[str]) -> DataFrame:
        many = df.groupBy(*keys).count().where(F.col("count") > 1)
        return many.agg(F.count("*").alias("n_bad")).select(
            F.lit("error").alias("level"), F.lit(where).alias("where"), F.lit("duplicate rows").alias("what"), "n_bad")

    def steps(df: DataFrame, name: str) -> DataFrame:
        # A set of steps: at most the horizon.
        return df.groupBy(*index, "regime", "variable").agg(F.array_sort(F.collect_set("t")).alias(name))

    index = ["uncertainty"] if "uncertainty" in baseline.columns and "uncertainty" in shocked.columns else []
    joint = steps(baseline, "_b").join(steps(shocked, "_s"), [*index, "regime", "variable"], "full")
    both = F.col("_b").isNotNull() & F.col("_s").isNotNull()
    aligned = joint.agg(
        one_if(F.count_if(both) == 0).alias("none"), F.count_if(both & (F.col("_b") != F.col("_s"))).alias("differ")
    ).select(F.inline(F.array(
        F.struct(F.lit("error").alias("level"), F.lit("overlap").alias("where"),
                 F.lit("no common variables and regimes").alias("what"), F.col("none").cast("long").alias("n_bad")),
        F.struct(F.lit("error").alias("level"), F.lit("alignment").alias("where"),
                 F.lit("different sets of t").alias("what"), F.col("differ").cast("long").alias("n_bad")),
    )))
    base_keys = [k for k in ("uncertainty",) if k in baseline.columns] + ["regime", "variable", "t"]
    shock_keys = [k for k in ("uncertainty",) if k in shocked.columns] + ["scenario", "regime", "variable", "t"]
    return (
        whole_step(baseline, "baseline").unionByName(whole_step(shocked, "shocked"))
        .unionByName(duplicates(baseline, "baseline", base_keys))
        .unionByName(duplicates(shocked, "shocked", shock_keys))
        .unionByName(aligned)
    )
