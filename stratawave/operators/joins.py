"""Panel and scenario joins.

No side is broadcast by hint: Spark decides by the measured size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratawave.operators.reshape import to_wide


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str],
                salt: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join on few or skewed keys: rows of ``left`` with one key go to ``salt``
    partitions by a hash of ``spread_by``; ``right``, the smaller side, is repeated."""
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salt)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def merge_index(panel: DataFrame, index: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """Left join of one index series (distinct dates) onto the panel."""
    one = index.select(date, value).dropDuplicates([date])
    return panel.join(one, date, "left")


def match_rate(merged: DataFrame, value: str = "value") -> DataFrame:
    return merged.agg(
        F.count("*").alias("n_rows"),
        F.count(value).alias("n_matched"),
        F.round(100.0 * F.count(value) / F.count("*"), 2).alias("pct_matched"),
    )


def merge_all_indices(panel: DataFrame, indices: DataFrame, names: Sequence[str], date: str = "date") -> DataFrame:
    """All indices as columns: pivoted once, joined once."""
    return panel.join(to_wide(indices, [date], "index", "value", names), date, "left")


def scenario_keys(*frames: DataFrame) -> list[str]:
    """Join keys of scenario tables; ``uncertainty`` counts if every table has it."""
    base = ["scenario", "regime", "variable", "t"]
    shared = all("uncertainty" in f.columns for f in frames)
    return (["uncertainty"] if shared else []) + base


def delta_from_baseline(shocked: DataFrame, baseline: DataFrame, keep: Sequence[str] = ("scenario",)) -> DataFrame:
    """Value minus baseline, a missing baseline counts as zero."""
    keys = (["uncertainty"] if "uncertainty" in shocked.columns and "uncertainty" in baseline.columns else [])
    keys += ["regime", "variable", "t"]
    base = baseline.select(*keys, F.col("value").alias("_base"))
    joined = shocked.join(base, keys, "left")
    cols = [k for k in keys if k == "uncertainty"] + list(keep) + ["regime", "variable", "t"]
    return joined.select(*cols, (F.col("value") - F.coalesce("_base", F.lit(0.0))).alias("delta"))


def baseline_vs_shocked(tidy: DataFrame) -> DataFrame:
    """Baseline, shocked and delta per key; a key with only one half keeps it.

    The outer join of the two halves on unique keys, done as one aggregation so that
    the table is read once.
    """
    keys = [k for k in ("uncertainty", "scenario", "regime", "variable", "t") if k in tidy.columns]
    half = {"baseline": F.col("is_baseline"), "shocked": ~F.col("is_baseline")}
    return tidy.groupBy(*keys).agg(*[F.max(F.when(c, F.col("value"))).alias(n) for n, c in half.items()]).withColumn(
        "delta", F.col("shocked") - F.col("baseline"))
