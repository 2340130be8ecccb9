"""Cleaning, renaming and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratawave import lookups
from stratawave.functions import scalars
from stratawave.sources.readers import numeric_columns


def coerce_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns to numbers; columns that are numeric already stay as they are."""
    numeric = set(numeric_columns(df))
    return df.withColumns({
        c: F.col(c).cast("double") if c in numeric else scalars.coerce_number(F.col(c)) for c in columns
    })


def type_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per expected column: type found, type match, NULLs.  One aggregation."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(F.count("*").alias("_n"), *[
        F.count_if(F.col(f.name).isNull()).alias(f.name) for f in schema.fields if f.name in have
    ])
    rows = F.array(*[
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(have.get(f.name)).cast("string").alias("found"),
            F.lit(have.get(f.name) == f.dataType.simpleString()).alias("type_ok"),
            (F.col(f.name) if f.name in have else F.col("_n")).cast("long").alias("n_null"),
        )
        for f in schema.fields
    ])
    return counts.select(F.inline(rows))


def rename_explicit(names: DataFrame, column: str = "original",
                    mapping: Mapping[str, str] = lookups.EXPLICIT_NAMES) -> DataFrame:
    """Name table with ``clean``: dictionary first, then snake case."""
    raw = F.col(column)
    return names.withColumn("clean", scalars.lookup(raw, mapping, default=scalars.snake_case(raw)))


def _alignment_distance(a: str, b: str, limit: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two short names.

    Rows that already exceed ``limit`` everywhere stop early.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > limit:
            return limit + 1
        two, one = one, row
    return one[-1]


def near_names(names: DataFrame, column: str = "clean", dictionary: Mapping[str, str] = lookups.NEAR_NAMES,
               threshold: int = 2, blocked: Sequence[str] | None = None) -> DataFrame:
    """Nearest dictionary name within ``threshold`` edits: ``matched``, ``mapped``, ``distance``.

    ``names`` holds distinct names, not data rows; the dictionary is fixed, so no
    join is made.  The first entry with the smallest distance wins.
    """
    keys = list(dictionary)
    blocked = [b.lower() for b in (lookups.EXPLICIT_NAMES if blocked is None else blocked)] + ["date"]

    @F.pandas_udf("matched string, distance int")
    def nearest(batch: pd.Series) -> pd.DataFrame:
        out = []
        for name in batch:
            scored = [(_alignment_distance(name, k, threshold), i) for i, k in enumerate(keys)] if name else []
            best = min(scored, default=(threshold + 1, 0))
            out.append((keys[best[1]], best[0]) if best[0] <= threshold else (None, None))
        return pd.DataFrame(out, columns=["matched", "distance"]).astype({"distance": "Int32"})

    free = F.when(~F.lower(column).isin(*blocked), F.col(column))
    hit = names.withColumn("_hit", nearest(free))
    return hit.select(
        *names.columns,
        F.col("_hit.matched").alias("matched"),
        F.coalesce(scalars.lookup(F.col("_hit.matched"), dictionary), F.col(column)).alias("mapped"),
        F.col("_hit.distance").alias("distance"),
    )


def standardize_series_names(df: DataFrame, series: str = "series",
                             explicit: Mapping[str, str] = lookups.EXPLICIT_NAMES,
                             dictionary: Mapping[str, str] = lookups.NEAR_NAMES,
                             threshold: int = 2) -> tuple[DataFrame, DataFrame]:
    """Long table with canonical names, and the mapping report."""
    names = df.select(F.col(series).alias("original")).distinct()
    report = near_names(rename_explicit(names, "original", explicit), "clean", dictionary,
                        threshold, blocked=list(explicit))
    renamed = df.join(report.select(F.col("original").alias(series), "mapped"), series).withColumn(
        series, F.col("mapped")
    ).drop("mapped")
    return renamed, report


def coalesce_renamed(df: DataFrame, mapped: str, position: str, keys: Sequence[str] = ("date",),
                     value: str = "price") -> DataFrame:
    """Columns renamed to one name: per key the first non-null value in column order."""
    return df.groupBy(*keys, mapped).agg(
        F.min_by(value, F.when(F.col(value).isNotNull(), F.col(position))).alias(value)
    )


def clean_index(df: DataFrame, source: str,
                columns: Mapping[str, tuple[str, str]] = lookups.INDEX_COLUMNS) -> DataFrame:
    """Source-specific columns to ``(index, date, value)`` without NULL values."""
    by_lower = {c.lower(): c for c in df.columns}
    if source not in columns:
        raise ValueError(f"unsupported index {source!r}")
    date, value = columns[source]
    if date not in by_lower and "date" in by_lower:
        date = "date"
    if value not in by_lower:
        value = next((c for c in by_lower if source in c), "value")
    if date not in by_lower or value not in by_lower:
        raise ValueError(f"{source}: needs {date!r} and {value!r}, has {df.columns}")
    number = F.col(by_lower[value]).cast("string").try_cast("double")
    return df.select(
        F.lit(source).alias("index"),
        F.col(by_lower[date]).cast("string").try_cast("date").alias("date"),
        scalars.clean_double(number).alias("value"),
    ).where(F.col("value").isNotNull())


def study_set(df: DataFrame, members: Sequence[str], series: str = "series") -> DataFrame:
    """Rows of the wanted series, names compared without case.  Reaches the scan as a filter."""
    return df.where(F.lower(series).isin(*[m.lower() for m in members]))


def missing_members(df: DataFrame, members: Sequence[str], series: str = "series") -> DataFrame:
    wanted = df.sparkSession.createDataFrame([(m.lower(),) for m in members], "member string")
    present = df.select(F.lower(series).alias("member")).distinct()
    return wanted.join(present, "member", "left_anti")


def complete_series(df: DataFrame, min_obs: int, series: str = "series",
                    value: str = "price") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Series with at least ``min_obs`` values; the dropped ones; a summary row."""
    counts = df.groupBy(series).agg(F.count(value).alias("n_obs"))
    ok = F.col("n_obs") >= min_obs
    kept = df.join(counts.where(ok).select(series), series, "left_semi")
    dropped = counts.where(~ok)
    summary = counts.agg(
        F.count("*").alias("n_series"),
        F.count_if(ok).alias("retained"),
        F.count_if(~ok).alias("dropped"),
        F.round(100.0 * F.avg(ok.cast("double")), 1).alias("retained_pct"),
    ).withColumn("min_obs", F.lit(min_obs))
    return kept, dropped, summary


def date_window(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows between two dates, an absent bound is open.  Pushed to the scan."""
    if start is not None:
        df = df.where(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col(date) <= F.lit(end).cast("date"))
    return df


def row_mask(columns: Sequence[str], missing_allowed: int = 0) -> Column:
    return scalars.n_missing(columns) <= missing_allowed


def common_sample(df: DataFrame, columns: Sequence[str], min_present: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with enough non-null columns, and the report of the filter (one aggregation)."""
    need = len(columns) if min_present is None else min_present
    present = F.lit(len(columns)) - scalars.n_missing(columns)
    ok = present >= need
    report = df.agg(
        F.count("*").alias("rows_before"),
        F.count_if(ok).alias("rows_after"),
        F.round(100.0 * F.avg(ok.cast("double")), 2).alias("pct_retained"),
        F.min(F.when(ok, F.col("date"))).alias("date_start"),
        F.max(F.when(ok, F.col("date"))).alias("date_end"),
        *[F.round(F.avg(F.col(c).isNull().cast("double")), 3).alias(f"na_{c}") for c in columns],
    )
    return df.where(ok), report


def complete_dates(df: DataFrame, n_series: Column | int, keys: Sequence[str] = ("date",),
                   value: str = "ret") -> DataFrame:
    """Rows of the dates on which all ``n_series`` series have a value."""
    full = df.groupBy(*keys).agg(F.count(value).alias("_n")).where(F.col("_n") == n_series)
    return df.join(full.select(*keys), list(keys), "left_semi")


def varying_series(df: DataFrame, keys: Sequence[str] = ("series",), value: str = "ret") -> DataFrame:
    """Without the series that have no variance."""
    moving = df.groupBy(*keys).agg(F.var_samp(value).alias("_v")).where(F.col("_v") > 0)
    return df.join(moving.select(*keys), list(keys), "left_semi")


def duplicate_series(df: DataFrame, series: str = "series", date: str = "date", value: str = "ret",
                     tol: float = 1.5e-8) -> DataFrame:
    """Later members of groups of equal series: ``(series, duplicate_of)``.

    Exact copies fall together under one content hash, whatever their number.
    What is left is compared only with series whose absolute totals are close
    enough for the mean difference to be below ``tol``: a bucketed equi-join.
    """
    filled = df.where(F.col(value).isNotNull())
    content = F.xxhash64(F.col(date), F.col(value) + F.lit(0.0)).cast("decimal(38,0)")
    other = F.hash(F.col(value) + F.lit(0.0), F.col(date)).cast("decimal(38,0)")
    profile = filled.groupBy(series).agg(
        F.sum(content).alias("_h1"), F.sum(other).alias("_h2"),
        F.count("*").alias("_n"), F.sum(F.abs(value)).alias("_total"),
    )
    by_content = profile.groupBy("_h1", "_h2", "_n").agg(F.min(series).alias("first"), F.first("_total").alias("_total"))
    exact = profile.join(by_content.drop("_total"), ["_h1", "_h2", "_n"]).where(
        F.col(series) > F.col("first")
    ).select(F.col(series), F.col("first").alias("duplicate_of"))

    width = F.log1p(F.lit(4.0 * tol))
    bucket = F.when(F.col("_total") > 0, F.floor(F.ln("_total") / width)).otherwise(F.lit(-(2**62)))
    reps = by_content.select(F.col("first").alias("a"), "_n", "_total", bucket.alias("_b"))
    near = reps.select(F.col("a").alias("b"), "_n", F.col("_total").alias("_tb"), F.explode(
        F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)
    ).alias("_b"))
    pairs = reps.join(near, ["_n", "_b"]).where(
        (F.col("a") < F.col("b")) & (F.abs(F.col("_total") - F.col("_tb")) <= 2 * tol * F.col("_total"))
    ).select("a", "b", "_n")
    left = filled.select(F.col(series).alias("a"), F.col(date).alias("_d"), F.col(value).alias("_x"))
    right = filled.select(F.col(series).alias("b"), F.col(date).alias("_d"), F.col(value).alias("_y"))
    compared = pairs.join(left, "a").join(right, ["b", "_d"]).groupBy("a", "b", "_n").agg(
        F.count("*").alias("_m"),
        F.sum(F.abs(F.col("_x") - F.col("_y"))).alias("_diff"), F.sum(F.abs("_x")).alias("_size"),
    ).where((F.col("_m") == F.col("_n")) & (F.col("_diff") <= tol * F.col("_size")))
    close = compared.groupBy(F.col("b").alias(series)).agg(F.min("a").alias("duplicate_of"))
    return exact.unionByName(close)


def distinct_series(df: DataFrame, series: str = "series", date: str = "date", value: str = "ret") -> DataFrame:
    return df.join(duplicate_series(df, series, date, value).select(series).distinct(), series, "left_anti")


def typed_panel(df: DataFrame, ids: Sequence[str] = ("series_id", "series_name", "unit")) -> DataFrame:
    """Id columns as text, the date as a date, everything else as numbers (bad text is NULL)."""
    def typed(c: str) -> Column:
        if c == "date":
            return F.col(c).cast("date")
        if c in ids:
            return F.col(c).cast("string")
        return scalars.clean_double(F.col(c).cast("string").try_cast("double"))

    return df.select(*[typed(c).alias(c) for c in df.columns])


def trim_to_index(panel: DataFrame, index: DataFrame, date: str = "date") -> DataFrame:
    """Panel rows within the span of the index, which is one scalar subquery."""
    span = index.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("span")).scalar()
    return panel.where((F.col(date) >= span["lo"]) & (F.col(date) <= span["hi"]))


def canonical_panel(df: DataFrame, series: str = "series") -> DataFrame:
    """The eight panel columns in order, with a slug id and an empty unit."""
    return df.select(
        "date", scalars.slug(F.col(series)).alias("series_id"), F.col(series).alias("series_name"),
        F.lit(None).cast("string").alias("unit"), "price", "ln_price", "ret", "vol_proxy",
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Row bind; columns that a frame lacks become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
