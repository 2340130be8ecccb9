"""Ordered operators on series.

Every window is partitioned by the series.  A series has one row per calendar
step (``checks.key_duplicates`` verifies it), so its length is bounded by the
calendar whatever the size of the raw data; :func:`aggregate.bucket` brings raw
rows to that form.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions.quantiles import exact_quantiles
from stratawave.operators.reshape import to_wide


def ordered(keys: Sequence[str], order: str = "date") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str]) -> WindowSpec:
    return W.partitionBy(*keys)


def log_return(df: DataFrame, keys: Sequence[str] = ("series",), order: str = "date", price: str = "price",
               out: str = "log_return", scale: float = 1.0) -> DataFrame:
    """``scale * ln(p / previous p)``; NULL if either is missing or not positive."""
    before = F.lag(price).over(ordered(keys, order))
    ok = (before > 0) & (F.col(price) > 0)
    change = F.ln(F.col(price) / before)
    return df.withColumn(out, F.when(ok, change * scale if scale != 1.0 else change))


def panel_returns(df: DataFrame, keys: Sequence[str] = ("series",), order: str = "date") -> DataFrame:
    """``ln_price`` and ``ret`` next to the price."""
    priced = df.withColumn("ln_price", F.when(F.col("price") > 0, F.ln("price")))
    return log_return(priced, keys, order, out="ret")


def volatility_proxy(df: DataFrame, method: str = "squared", value: str = "ret", out: str = "vol_proxy",
                     clip: float | None = None) -> DataFrame:
    """Squared or absolute return, optionally cut at a quantile of the whole panel.

    The cut is one number from :func:`exact_quantiles`, used as a scalar subquery.
    """
    size = F.pow(F.col(value), F.lit(2.0)) if method == "squared" else F.abs(value)
    if method not in ("squared", "abs"):
        raise ValueError("method must be 'squared' or 'abs'")
    sized = df.withColumn(out, size)
    if clip is None:
        return sized
    limit = exact_quantiles(sized, [], out, [clip], ["limit"]).select("limit").scalar()
    return sized.withColumn(out, F.when(F.col(out).isNotNull(), F.least(F.col(out), limit)))


def moving_average(value: str, n: int, keys: Sequence[str], order: str = "date") -> Column:
    """Right-aligned mean of ``n`` rows; NULL until full and where a value is missing."""
    over = ordered(keys, order).rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(over) == n, F.avg(value).over(over))


def exponential_average(df: DataFrame, n: int = 3, keys: Sequence[str] = ("index",), order: str = "date",
                        value: str = "value", out: str = "ema") -> DataFrame:
    """Exponential average with ratio 2/(n+1), seeded by the mean of the first ``n`` values.

    The series is folded as one ordered array (bounded by the calendar).  Missing
    values before the first value are skipped; a later one makes the rest NULL.
    """
    ratio = 2.0 / (n + 1)
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(value)))).alias("_rows"))
    x = F.col(f"_rows.{value}")
    lead = F.coalesce(F.array_position(F.transform(x, lambda v: v.isNotNull()), True), F.lit(0)).cast("int")
    seed = F.aggregate(F.slice(x, F.greatest(lead, F.lit(1)), n), F.lit(0.0), lambda a, v: a + v) / n
    tail = F.slice(x, lead + n, F.greatest(F.size(x) - lead - n + 1, F.lit(0)))
    folded = F.aggregate(
        tail, F.array(seed), lambda acc, v: F.array_append(acc, F.element_at(acc, -1) + ratio * (v - F.element_at(acc, -1)))
    )
    enough = (lead > 0) & (F.size(x) >= lead + n - 1)
    values = F.when(enough, F.concat(F.array_repeat(F.lit(None).cast("double"), lead + n - 2), folded)).otherwise(
        F.array_repeat(F.lit(None).cast("double"), F.size(x))
    )
    zipped = F.arrays_zip(F.col("_rows").alias("r"), values.alias("e"))
    return rows.select(*keys, F.explode(zipped).alias("_z")).select(
        *keys, F.col(f"_z.r.{order}").alias(order), F.col(f"_z.r.{value}").alias(value), F.col("_z.e").alias(out)
    )


def interpolate(df: DataFrame, max_gap: int = 2, keys: Sequence[str] = ("index",), order: str = "date",
                value: str = "value", out: str = "filled") -> DataFrame:
    """Linear fill by row position of gaps of at most ``max_gap`` rows; ends stay."""
    over = ordered(keys, order)
    back = over.rowsBetween(W.unboundedPreceding, W.currentRow)
    ahead = over.rowsBetween(W.currentRow, W.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("_pos").alias("i"), F.col(value).alias("v")))
    pos = df.withColumn("_pos", F.row_number().over(over)).withColumn("_point", point)
    pos = pos.withColumn("_a", F.last("_point", ignorenulls=True).over(back))
    pos = pos.withColumn("_b", F.first("_point", ignorenulls=True).over(ahead))
    gap = F.col("_b.i") - F.col("_a.i") - 1
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_pos") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(gap <= max_gap, line)
    return pos.withColumn(out, filled).drop("_pos", "_point", "_a", "_b")


def common_span(df: DataFrame, index: str = "index", date: str = "date", value: str = "value") -> DataFrame:
    """Rows within the dates all indices share."""
    spans = df.where(F.col(value).isNotNull()).groupBy(index).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    both = spans.agg(F.struct(F.max("lo").alias("lo"), F.min("hi").alias("hi")).alias("span")).scalar()
    return df.where((F.col(date) >= both["lo"]) & (F.col(date) <= both["hi"]))


def zscore(value: str, keys: Sequence[str], flat: str = "null") -> Column:
    """(x - mean) / sample sd within the series.

    A series without spread gives NULL, or x - mean with ``flat="one"``.
    """
    over = whole(keys)
    sd = F.stddev_samp(value).over(over)
    centred = F.col(value) - F.avg(value).over(over)
    moves = sd > F.lit(2.220446049250313e-16)
    scaled = F.when(moves, centred / sd)
    return F.coalesce(scaled, centred) if flat == "one" else scaled


def index_to_100(value: str, keys: Sequence[str], order: str = "date") -> Column:
    """100 at the first value of the series."""
    base = F.first(value, ignorenulls=True).over(
        ordered(keys, order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    return F.when(base != 0, 100.0 * F.col(value) / base)


def min_max(value: str, keys: Sequence[str]) -> Column:
    lo, hi = F.min(value).over(whole(keys)), F.max(value).over(whole(keys))
    return F.when(hi > lo, (F.col(value) - lo) / (hi - lo))


def delay(value: str, d: int, keys: Sequence[str], order: str = "date") -> Column:
    return F.lag(value, d).over(ordered(keys, order))


def cumulative(value: str, keys: Sequence[str], order: str = "t") -> Column:
    return F.sum(value).over(ordered(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow))


def fill_state(state: str, keys: Sequence[str], order: str = "date") -> Column:
    """Carry a state forward, then backward; without any state it is 1."""
    over = ordered(keys, order)
    forward = F.last(state, ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    backward = F.first(state, ignorenulls=True).over(over.rowsBetween(W.currentRow, W.unboundedFollowing))
    return F.coalesce(forward, backward, F.lit(1))


def clean_returns(prices: DataFrame, columns: Sequence[str], date: str = "date", standardize: bool = True) -> DataFrame:
    """Wide price table to wide monthly log returns of the complete months.

    Each column is reduced to its last value of the month in one aggregation; the
    returns, the complete cases and the z-scores follow on one row per month.
    """
    month = F.trunc(date, "month").cast("date")
    last = prices.groupBy(month.alias("_m")).agg(
        F.max(date).alias("date"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date))).alias(c) for c in columns],
    )
    long = last.unpivot(["_m", "date"], list(columns), "series", "price")
    returns = log_return(long, ["series"], "_m", out="ret")
    wide = to_wide(returns, ["date"], "series", "ret", columns).dropna(subset=list(columns))
    if not standardize:
        return wide
    again = wide.unpivot(["date"], list(columns), "series", "ret").withColumn("ret", zscore("ret", ["series"]))
    return to_wide(again, ["date"], "series", "ret", columns)


def prepare_indices(df: DataFrame, smooth: str | None = "rollmean", impute: bool = True, align: bool = True,
                    standardize: bool = True, n: int = 3) -> DataFrame:
    """Smooth, fill short gaps, cut to the common span, standardise; long output."""
    keys = ["index"]
    if smooth == "rollmean":
        df = df.withColumn("value", moving_average("value", n, keys))
    elif smooth == "ema":
        df = exponential_average(df, n, keys).select("index", "date", F.col("ema").alias("value"))
    if impute:
        df = interpolate(df, 2, keys).withColumn("value", F.col("filled")).drop("filled")
    if align:
        df = common_span(df)
    if standardize:
        df = df.withColumn("value", zscore("value", keys))
    return df.where(F.col("value").isNotNull()).select("index", "date", "value")


def splice(before: DataFrame, after: DataFrame, cut: str, name: str, date: str = "date") -> DataFrame:
    """One index from two: ``before`` up to the cut date, ``after`` from it on."""
    point = F.lit(cut).cast("date")
    parts = before.where(F.col(date) < point).unionByName(after.where(F.col(date) >= point))
    return parts.select(F.lit(name).alias("index"), date, "value")
