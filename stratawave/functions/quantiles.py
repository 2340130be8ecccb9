"""Exact quantiles.

``series_quantile`` is for groups whose size is bounded (a series has at most one
row per calendar step).  ``exact_quantiles`` is for groups of any size: no group
is ever sorted inside one task.  One pass counts the values of each group in fine
buckets, which tells the bucket of every wanted rank; a second pass counts the
distinct values of these buckets only, and only they are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions.scalars import clean_double
from stratawave.session import cut_lineage

#: Buckets for each power of two, so a bucket's ends differ by 0.5 %.
FINE = 128
#: Most distinct values that one task ranks.
MOST = 1 << 20
#: Most wanted buckets that are broadcast to the second pass.
FEW = 100_000


def series_quantile(value: Column | str, p: float) -> Column:
    """Type-7 quantile aggregate (linear between order statistics)."""
    return F.percentile(value, F.lit(float(p)))


def _position(n: Column, p: float, kind: int) -> Column:
    """1-based fractional position of the quantile among ``n`` sorted values."""
    if kind == 7:
        return (n - 1) * F.lit(float(p)) + 1.0
    if kind == 8:
        raw = (n + F.lit(1.0 / 3.0)) * F.lit(float(p)) + F.lit(1.0 / 3.0)
        return F.least(F.greatest(raw, F.lit(1.0)), n.cast("double"))
    raise ValueError("kind must be 7 or 8")


def grid_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                   kind: int = 8, out: str = "grid") -> DataFrame:
    """Quantiles of bounded groups as one array column per group.

    The group is one ordered array (a driver series, one row per time step), so
    every probability is two element lookups instead of one sort each.
    """
    arr = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.sort_array(F.collect_list(value)).alias("_v")
    )
    n = F.size("_v")

    def at(p: Column) -> Column:
        if kind == 7:
            pos = (n - 1) * p + 1.0
        else:
            pos = (n + F.lit(1.0 / 3.0)) * p + F.lit(1.0 / 3.0)
        # A hair above a whole position is rounding noise of the product.
        near = F.floor(pos + F.lit(4 * 2.220446049250313e-16) * F.greatest(pos, F.lit(1.0)))
        lo = F.least(F.greatest(near, F.lit(1)), n).cast("int")
        hi = F.least(F.greatest(near + 1, F.lit(1)), n).cast("int")
        frac = F.greatest(pos - near, F.lit(0.0))
        a, b = F.element_at("_v", lo), F.element_at("_v", hi)
        return F.when(frac < 1e-12, a).otherwise(a + frac * (b - a))

    grid = F.transform(F.array(*[F.lit(float(p)) for p in probs]), at)
    return arr.select(*keys, grid.alias(out), n.alias("n"))


def bucket(v: Column, fine: int = FINE) -> Column:
    """Number of the bucket of a finite double, in the order of the values.

    The scale is logarithmic on both sides of zero; the exponent of a double is above -1100.
    """
    size = F.floor((F.log2(F.abs(v)) + 1100) * fine)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def _wanted(table: DataFrame, group: Sequence[str], order: str, start: Column) -> DataFrame:
    """Rows of ``table`` with the ranks (of array ``_ranks``) that they cover.

    A row has ``_c`` values; those of earlier rows of its group and ``start`` come before them.
    """
    over = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = table.withColumn("_upto", start + F.sum("_c").over(over)).withColumn("_before", F.col("_upto") - F.col("_c"))
    covered = F.filter("_ranks", lambda r: (r > F.col("_before")) & (r <= F.col("_upto")))
    return counted.withColumn("_ranks", covered).where(F.size("_ranks") > 0).drop("_upto")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                    names: Sequence[str], kind: int = 7, fine: int = FINE, most: int = MOST, few: int = FEW,
                    salt: int = 8, moments: tuple[str, str] | None = None) -> DataFrame:
    """One row per group with the exact quantiles ``names`` of ``value``.

    NULL, NaN and infinite values do not count.  ``df`` is read twice, so its values must be
    reproducible: stored columns, or aggregates that were rounded or checkpointed.

    1. Values are counted per (group, bucket) with map-side combining.  Counts of buckets add up in any
       order, and they are exact, so running sums give the bucket of each wanted rank.
    2. The distinct values of the wanted buckets are counted per (group, bucket, value).  The rows meet their
       buckets by broadcast if these are ``few``, else by a join salted by value.
    3. A bucket with more than ``most`` distinct values is cut into equal parts between its ends, in the counted
       table, until no part that holds a wanted rank has more.  Ends and the rest are then ranked.

    A bucket of equal values, however many, is solved by its ends.  ``moments`` names the mean and the sample
    standard deviation, which are put together from those of the buckets.
    """
    given, keys = list(keys), list(keys) or ["_all"]
    if not given:
        df = df.withColumn("_all", F.lit(0))
    v = F.col("_v")
    rows = df.select(*keys, clean_double(F.col(value).cast("double")).alias("_v")).where(v.isNotNull())
    rows = rows.withColumn("_b", bucket(v, fine))
    parts = [F.avg("_v").alias("_mean"), F.var_pop("_v").alias("_var")] if moments else []
    first = cut_lineage(rows.groupBy(*keys, "_b").agg(
        F.count("*").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *parts))
    n = F.col("_n")
    positions = [_position(n, p, kind) for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(pos).cast("long"), F.least(F.floor(pos) + 1, n).cast("long")) for pos in positions
    ])))
    whole = W.partitionBy(*keys)
    state = _wanted(first.select(*keys, "_b", "_c", "_lo", "_hi", F.sum("_c").over(whole).alias("_n"))
                    .withColumn("_ranks", ranks), keys, "_b", F.lit(0))
    state = cut_lineage(state.select(*keys, "_b", "_before", "_c", "_lo", "_hi", "_ranks", "_n"))

    # What the ends of a part tell needs no ranking.
    at_end = F.filter("_ranks", lambda r: (F.col("_lo") == F.col("_hi")) | (r == F.col("_before") + 1) | (r == F.col("_before") + F.col("_c")))

    def ends(parts_: DataFrame) -> DataFrame:
        told = F.transform(at_end, lambda r: F.struct(r.alias("_rank"), F.when(r == F.col("_before") + 1, F.col("_lo")).otherwise(F.col("_hi")).alias("_value")))
        return parts_.select(*keys, F.inline(told))

    def inner(parts_: DataFrame) -> DataFrame:
        return parts_.withColumn("_ranks", F.array_except("_ranks", at_end)).where(F.size("_ranks") > 0)

    found = [ends(state)]
    part = [*keys, "_b"]
    asked = inner(state).select(*part, "_before", "_ranks")
    n_asked = asked.count()
    if n_asked:
        if n_asked <= few:
            hit = rows.join(F.broadcast(asked), part)
        else:
            salts = asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
            hit = rows.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salt)).cast("int")).join(salts, [*part, "_salt"])
        values = cut_lineage(hit.groupBy(*part, "_before", "_ranks", "_v").agg(F.count("*").alias("_c")))
        while True:
            sizes = values.groupBy(*part, "_before", "_ranks").agg(F.count("*").alias("_d"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
            if (sizes.agg(F.max("_d")).first()[0] or 0) <= most:
                break
            cells = max(2, min(4096, most))
            at = F.floor((v / 2 - F.col("_from") / 2) / (F.col("_to") / 2 - F.col("_from") / 2) * cells)
            cut = values.join(sizes, [*part, "_before", "_ranks"]).withColumn(
                "_cell", F.when(F.col("_d") > most, F.least(at, F.lit(cells - 1))).otherwise(F.lit(0)).cast("long"))
            cut = cut_lineage(cut.drop("_d", "_from", "_to"))
            counted = cut.groupBy(*part, "_before", "_ranks", "_cell").agg(
                F.sum("_c").alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumnRenamed("_before", "_start")
            kept = cut_lineage(_wanted(counted, [*part, "_start"], "_cell", F.col("_start")))
            found.append(ends(kept))
            kept = inner(kept).select(*part, "_start", "_cell", "_before", "_ranks")
            values = cut.withColumnRenamed("_before", "_start").drop("_ranks").join(kept, [*part, "_start", "_cell"])
            values = cut_lineage(values.select(*part, "_before", "_ranks", "_v", "_c"))
        ranked = _wanted(values.withColumnRenamed("_before", "_start"), [*part, "_start"], "_v", F.col("_start"))
        found.append(ranked.select(*keys, F.explode("_ranks").alias("_rank"), F.col("_v").alias("_value")))
    told = found[0]
    for more in found[1:]:
        told = told.unionByName(more)
    told = told.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_value"))).alias("_at"))
    sums = [F.sum("_c").alias("_n")]
    if moments:
        mean = (F.sum(F.col("_c") * F.col("_mean")) / F.sum("_c")).alias("_m")
        middle = first.groupBy(*keys).agg(*sums, mean)
        far = F.sum(F.col("_c") * (F.col("_var") + (F.col("_mean") - F.col("_m")) * (F.col("_mean") - F.col("_m"))))
        of = first.join(middle.select(*keys, "_m"), keys)
        totals = of.groupBy(*keys).agg(*sums, F.first("_m").alias(moments[0]), F.when(F.sum("_c") > 1, F.sqrt(far / (F.sum("_c") - 1))).alias(moments[1]))
    else:
        totals = first.groupBy(*keys).agg(*sums)
    joined = totals.join(told, keys)
    out = []
    for pos, name in zip(positions, names):
        lo = F.element_at("_at", F.floor(pos).cast("long"))
        hi = F.element_at("_at", F.least(F.floor(pos) + 1, n).cast("long"))
        frac = pos - F.floor(pos)
        out.append((lo + frac * (hi - lo)).alias(name))
    return joined.select(*given, *out, *(moments or ()))
