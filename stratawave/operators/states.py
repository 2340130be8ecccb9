"""Regime states, spells and transitions.

State 1 is low, 2 is high, NULL is unknown.  ``keys`` name the series a state path
belongs to (an index, a model); every window holds one path, one row per step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratawave.functions.distributions import normal_quantile
from stratawave.operators import series as S

CELLS = (("low", "low"), ("low", "high"), ("high", "low"), ("high", "high"))


def state_from_threshold(x: Column, theta: Column) -> Column:
    """1 up to the threshold, 2 above it, NULL where ``x`` is missing."""
    return F.when(x.isNull() | theta.isNull(), F.lit(None).cast("int")).when(x <= theta, 1).otherwise(2)


def state_label(state: Column) -> Column:
    """``low``/``high`` for 1/2 and the usual spellings, other labels as they are."""
    text = F.lower(state.cast("string"))
    return F.when(text.isin("1", "low", "l", "regime1"), "low").when(
        text.isin("2", "high", "h", "regime2"), "high"
    ).otherwise(state.cast("string"))


def delayed_flags(df: DataFrame, thresholds: DataFrame, delay: int | str = 1, keys: Sequence[str] = ("index",),
                  order: str = "date", value: str = "value", theta: str = "theta") -> DataFrame:
    """High flag of the driver ``d`` steps ago, for all indices in one table.

    ``thresholds`` has the keys, the threshold and, if ``delay`` is a column name, the delay.
    """
    over = W.partitionBy(*keys).orderBy(order)
    joined = df.join(thresholds, list(keys))
    if isinstance(delay, str):
        # The delay differs per key: look up the row by its position.
        joined = joined.withColumn("_pos", F.row_number().over(over))
        source = joined.select(*keys, (F.col("_pos") + F.col(delay)).alias("_pos"), F.col(value).alias("x"))
        joined = joined.join(source, [*keys, "_pos"], "left").drop("_pos")
    else:
        joined = joined.withColumn("x", F.lag(value, delay).over(over))
    return joined.select(*keys, order, "x", (F.col("x") > F.col(theta)).cast("int").alias("high"))


def hysteresis(df: DataFrame, theta: Column, width: float = 0.15, keys: Sequence[str] = ("index",),
               order: str = "date", value: str = "value", out: str = "state") -> DataFrame:
    """High above theta + band, low below theta - band, unchanged between; band = width * sd.

    The first row decides by the plain threshold; a missing first value starts low.
    """
    over = W.partitionBy(*keys).orderBy(order)
    sd = F.stddev_samp(value).over(W.partitionBy(*keys))
    band = width * F.when(sd > 0, sd).otherwise(F.lit(1.0))
    x = F.col(value)
    first = F.row_number().over(over) == 1
    signal = (
        F.when(first, F.when(x.isNull() | (x <= theta), 1).otherwise(2))
        .when(x > theta + band, 2)
        .when(x < theta - band, 1)
    )
    marked = df.withColumn("_signal", signal)
    carried = F.last("_signal", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn(out, carried).drop("_signal")


def number_runs(df: DataFrame, keys: Sequence[str], order: str, state: str) -> DataFrame:
    """Row position ``idx`` and run number ``run`` (NULL at missing states, which break runs)."""
    over = W.partitionBy(*keys).orderBy(order)
    starts = F.col(state).isNotNull() & ~F.coalesce(F.lag(state).over(over) == F.col(state), F.lit(False))
    marked = df.withColumns({"idx": F.row_number().over(over), "_start": starts.cast("int")})
    run = F.sum("_start").over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    return marked.withColumn("run", F.when(F.col(state).isNotNull(), run)).drop("_start")


def spells(df: DataFrame, keys: Sequence[str] = ("index",), order: str = "date", state: str = "state",
           min_spell: int = 1) -> DataFrame:
    """Runs of one state: id, regime, first and last position and date, duration.

    With ``min_spell`` a short run is added to the last run that was kept.  The first
    run after a gap is always kept, and equal neighbours are not merged again.
    """
    runs = number_runs(df, keys, order, state).where(F.col("run").isNotNull()).groupBy(*keys, "run").agg(
        F.first(state).alias("_state"),
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"),
        F.min(order).alias("start_date"), F.max(order).alias("end_date"),
        F.count("*").cast("int").alias("duration"),
    )
    over = W.partitionBy(*keys).orderBy("run")
    if min_spell > 1:
        opens = F.coalesce(F.lag("end_idx").over(over) + 1 != F.col("start_idx"), F.lit(True))
        kept = (opens | (F.col("duration") >= min_spell)).cast("int")
        group = F.sum("_kept").over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
        runs = runs.withColumn("_kept", kept).withColumn("_group", group).groupBy(*keys, "_group").agg(
            F.min_by("_state", "run").alias("_state"), F.min("run").alias("run"),
            F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"),
            F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"),
            F.sum("duration").cast("int").alias("duration"),
        )
    return runs.select(
        *keys, F.row_number().over(over).alias("spell_id"), state_label(F.col("_state")).alias("regime"),
        "start_idx", "end_idx", "start_date", "end_date", "duration",
    )


def spell_ids(df: DataFrame, spell_table: DataFrame, keys: Sequence[str] = ("index",), order: str = "date",
              state: str = "state") -> DataFrame:
    """Each row with the id of its spell; rows without a state keep NULL.

    A spell's id is carried forward from its first row, so no range join is needed.
    """
    over = W.partitionBy(*keys).orderBy(order)
    heads = spell_table.select(*keys, F.col("start_date").alias(order), "spell_id")
    joined = df.join(heads, [*keys, order], "left")
    carried = F.last("spell_id", ignorenulls=True).over(over.rowsBetween(W.unboundedPreceding, W.currentRow))
    return joined.withColumn("spell_id", F.when(F.col(state).isNotNull(), carried))


def smooth_short_spells(df: DataFrame, min_len: int = 2, keys: Sequence[str] = ("index",), order: str = "date",
                        state: str = "state", out: str = "state") -> DataFrame:
    """Give short spells the state of a neighbour: the first takes the next one's, the
    last the previous one's, a middle one that of the longer neighbour (right on a tie).

    Decisions run left to right on already changed values with the original lengths.
    A spell either fixes its state, whatever came before, or hands on the state before
    it; so its state is the last fixed one of the spells up to it, a running window.
    """
    runs = number_runs(df, keys, order, state)
    spell = runs.where(F.col("run").isNotNull()).groupBy(*keys, "run").agg(F.first(state).alias("_s"), F.count("*").alias("_n"))
    path = W.partitionBy(*keys).orderBy("run")
    right, after, before = F.lead("_s").over(path), F.lead("_n").over(path), F.lag("_n").over(path)
    fixed = (
        F.when(F.col("_n") >= min_len, F.col("_s"))
        .when(before.isNull(), F.coalesce(right, F.col("_s")))
        .when(after >= before, right)
    )
    so_far = path.rowsBetween(W.unboundedPreceding, W.currentRow)
    changed = spell.withColumn("_f", fixed).select(*keys, "run", F.last("_f", ignorenulls=True).over(so_far).alias("_new"))
    joined = runs.join(changed, [*keys, "run"], "left")
    return joined.withColumn(out, F.col("_new")).drop("_new", "run", "idx")


def spell_summary(spell_table: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Count, mean, median, sd, min, max of durations and the share of time per regime."""
    total = F.sum("_sum").over(W.partitionBy(*keys))
    return spell_table.groupBy(*keys, "regime").agg(
        F.count("*").alias("n_spells"),
        F.avg("duration").alias("mean_duration"),
        F.median("duration").alias("median_duration"),
        F.stddev_samp("duration").alias("sd_duration"),
        F.min("duration").alias("min_duration"),
        F.max("duration").alias("max_duration"),
        F.sum("duration").alias("_sum"),
    ).withColumn("time_share", F.col("_sum") / total).drop("_sum")


def transition_counts(df: DataFrame, keys: Sequence[str] = ("index",), order: str = "date", state: str = "state",
                      add: float = 0.0, skip_null_rows: bool = False) -> DataFrame:
    """Counts ``n11 n12 n21 n22`` per path.

    Pairs with a missing state are dropped; ``skip_null_rows`` removes the missing
    rows before pairing instead.  ``add`` is added to every cell.
    """
    if skip_null_rows:
        df = df.where(F.col(state).isin(1, 2))
    nxt = F.lead(state).over(W.partitionBy(*keys).orderBy(order))
    pairs = df.select(*keys, F.col(state).alias("_a"), nxt.alias("_b"))

    def cell(a: int, b: int) -> Column:
        return F.count_if((F.col("_a") == a) & (F.col("_b") == b)) + F.lit(add)

    return pairs.groupBy(*keys).agg(
        cell(1, 1).cast("double").alias("n11"), cell(1, 2).cast("double").alias("n12"),
        cell(2, 1).cast("double").alias("n21"), cell(2, 2).cast("double").alias("n22"),
    )


def transition_probs(counts: DataFrame, empty_row: float | None = 0.0) -> DataFrame:
    """Row shares ``p11 p12 p21 p22``; a row without pairs gets ``empty_row``."""
    fallback = F.lit(empty_row).cast("double")

    def share(part: str, other: str) -> Column:
        total = F.col(part) + F.col(other)
        return F.when(total > 0, F.col(part) / total).otherwise(fallback)

    return counts.withColumns({
        "p11": share("n11", "n12"), "p12": share("n12", "n11"),
        "p21": share("n21", "n22"), "p22": share("n22", "n21"),
    })


def renormalize(probs: DataFrame) -> DataFrame:
    """Negative entries to zero, rows to sum one, an empty row to one half each."""
    def fixed(part: str, other: str) -> Column:
        a, b = F.greatest(F.col(part), F.lit(0.0)), F.greatest(F.col(other), F.lit(0.0))
        return F.coalesce(F.try_divide(a, a + b), F.lit(0.5))

    return probs.withColumns({
        "p11": fixed("p11", "p12"), "p12": fixed("p12", "p11"),
        "p21": fixed("p21", "p22"), "p22": fixed("p22", "p21"),
    })


def tidy_transitions(probs: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """``(from, to, n, p)`` rows of the complete 2 x 2 grid."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("from"), F.lit(b).alias("to"), F.col(f"n{i}").alias("n"), F.col(f"p{i}").alias("p"))
        for (a, b), i in zip(CELLS, ("11", "12", "21", "22"))
    ])
    return probs.select(*keys, F.inline(cells))


def from_tidy_transitions(tidy: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Tidy ``(from, to, p)`` rows with any spelling of the states to one row per path."""
    a, b = state_label(F.col("from")), state_label(F.col("to"))

    def cell(x: str, y: str) -> Column:
        return F.coalesce(F.max(F.when((a == x) & (b == y), F.col("p"))), F.lit(0.0))

    return tidy.groupBy(*keys).agg(*[
        cell(x, y).alias(f"p{i}") for (x, y), i in zip(CELLS, ("11", "12", "21", "22"))
    ])


def persistence_interval(probs: DataFrame, keys: Sequence[str] = ("index",), conf: float = 0.95) -> DataFrame:
    """Normal-approximation error and interval of p11 and p22: ``(param, p, n, se, lo, hi)``."""
    z = F.lit(normal_quantile(0.5 + conf / 2))
    rows = F.array(*[
        F.struct(F.lit(name).alias("param"), F.when(F.col(x) + F.col(y) > 0, F.col(name)).alias("p"),
                 (F.col(x) + F.col(y)).alias("n"))
        for name, x, y in (("p11", "n11", "n12"), ("p22", "n21", "n22"))
    ])
    out = probs.select(*keys, F.inline(rows)).withColumn(
        "se", F.when(F.col("n") > 0, F.sqrt(F.col("p") * (1 - F.col("p")) / F.col("n")))
    )
    return out.withColumns({
        "lo": F.greatest(F.lit(0.0), F.col("p") - z * F.col("se")),
        "hi": F.least(F.lit(1.0), F.col("p") + z * F.col("se")),
    })


def interval_midpoints(ci: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    return ci.select(*keys, "param", ((F.col("lo") + F.col("hi")) / 2).alias("mid"), "lo", "hi")


def chain_summary(probs: DataFrame) -> DataFrame:
    """Long-run shares, expected durations, half-lives and mixing of a two-state chain."""
    p11, p12, p21, p22 = (F.col(c) for c in ("p11", "p12", "p21", "p22"))
    move = p12 + p21

    def half_life(p: Column) -> Column:
        return F.when((p > 0) & (p < 1), F.ln(F.lit(0.5)) / F.ln(p))

    return probs.withColumns({
        "pi_low": F.try_divide(p21, move),
        "pi_high": F.try_divide(p12, move),
        "expected_low": F.try_divide(F.lit(1.0), 1 - p11),
        "expected_high": F.try_divide(F.lit(1.0), 1 - p22),
        "half_life_low": half_life(p11),
        "half_life_high": half_life(p22),
        "lambda2": F.abs(p11 + p22 - 1),
        "ergodic": (p11 > 0) & (p12 > 0) & (p21 > 0) & (p22 > 0),
        "reversible": F.coalesce(F.abs(p12 * F.try_divide(p21, move) - p21 * F.try_divide(p12, move)) < 1e-10, F.lit(False)),
    })


def implied_durations(probs: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Mean durations the diagonal implies, and p11 + p22 (persistent above 1)."""
    return probs.select(
        *keys, "p11", "p22",
        F.try_divide(F.lit(1.0), 1 - F.col("p11")).alias("implied_low"),
        F.try_divide(F.lit(1.0), 1 - F.col("p22")).alias("implied_high"),
        (F.col("p11") + F.col("p22")).alias("persistence"),
    )


def block_length(spell_table: DataFrame, keys: Sequence[str] = ("index",)) -> DataFrame:
    """Bootstrap block length: the rounded median spell, at least 2."""
    return spell_table.groupBy(*keys).agg(
        F.greatest(F.lit(2), F.bround(F.median("duration")).cast("int")).alias("block_len")
    )


def bootstrap_transitions(df: DataFrame, blocks: DataFrame | int | None = None, draws: int = 2000,
                          keys: Sequence[str] = ("index",), order: str = "date", state: str = "state",
                          conf: float = 0.95, seed: int = 123) -> DataFrame:
    """Interval of p11 and p22 by resampling transition pairs, alone or in blocks.

    The counts of a block follow from its start, so they are prepared once per start
    by a window; a draw is then a join of its block starts with those counts.  Starts
    are hashes of (seed, path, draw, block): the result does not depend on partitions.
    ``blocks`` is a length for all paths, a table ``keys + block_len``, or None for single pairs.
    """
    over = W.partitionBy(*keys).orderBy(order)
    pairs = df.select(
        *keys, F.row_number().over(over).alias("start"), F.col(state).alias("_a"), F.lead(state).over(over).alias("_b"),
        (F.count("*").over(W.partitionBy(*keys)) - 1).alias("n_pairs"),
    ).where(F.col("start") <= F.col("n_pairs"))
    if isinstance(blocks, DataFrame):
        pairs = pairs.join(blocks, list(keys))
    else:
        pairs = pairs.withColumn("block_len", F.lit(int(blocks or 1)))
    pairs = pairs.withColumn("block_len", F.least("block_len", "n_pairs"))
    names = ("c11", "c12", "c21", "c22")
    cells = [((F.col("_a") == a) & (F.col("_b") == b)) for a in (1, 2) for b in (1, 2)]
    upto = W.partitionBy(*keys).orderBy("start").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = pairs.select(
        *keys, "start", "n_pairs", "block_len",
        *[F.sum(F.coalesce(c.cast("int"), F.lit(0))).over(upto).alias(n) for c, n in zip(cells, names)],
    )
    last = F.ceil(F.col("n_pairs") / F.col("block_len")).cast("int")
    paths = sums.where(F.col("start") == 1).select(*keys, "n_pairs", "block_len", last.alias("_n_blocks"))
    plan = paths.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn(
        "block", F.explode(F.sequence(F.lit(1), F.col("_n_blocks")))
    )
    room = F.col("n_pairs") - F.col("block_len") + 1
    size = F.when(F.col("block") < F.col("_n_blocks"), F.col("block_len")).otherwise(
        F.col("n_pairs") - F.col("block_len") * (F.col("_n_blocks") - 1)
    )
    picked = plan.withColumn(
        "_from", F.pmod(F.xxhash64(F.lit(seed), *keys, "draw", "block"), room)
    ).withColumn("_to", F.col("_from") + size)
    # Prefix counts at both ends of the block; position 0 has no row and counts zero.
    at_end = sums.select(*keys, F.col("start").alias("_to"), *[F.col(n).alias(f"{n}_to") for n in names])
    at_start = sums.select(*keys, F.col("start").alias("_from"), *[F.col(n).alias(f"{n}_from") for n in names])
    counted = picked.join(at_end, [*keys, "_to"]).join(at_start, [*keys, "_from"], "left").groupBy(*keys, "draw").agg(*[
        F.sum(F.col(f"{n}_to") - F.coalesce(f"{n}_from", F.lit(0))).alias(n) for n in names
    ])
    shares = counted.select(*keys, "draw", F.inline(F.array(
        F.struct(F.lit("p11").alias("param"),
                 F.when(F.col("c11") + F.col("c12") > 0, F.col("c11") / (F.col("c11") + F.col("c12"))).otherwise(0.0).alias("p")),
        F.struct(F.lit("p22").alias("param"),
                 F.when(F.col("c21") + F.col("c22") > 0, F.col("c22") / (F.col("c21") + F.col("c22"))).otherwise(0.0).alias("p")),
    )))
    lo = (1 - conf) / 2
    return shares.groupBy(*keys, "param").agg(
        F.count("*").alias("n_draws"), F.percentile("p", F.lit(lo)).alias("lo"),
        F.median("p").alias("mid"), F.percentile("p", F.lit(1 - lo)).alias("hi"),
    )


def regime_statistics(states: DataFrame, spell_table: DataFrame, probs: DataFrame, roots: DataFrame | None = None,
                      keys: Sequence[str] = ("index",), state: str = "state") -> DataFrame:
    """One row per path: shares, roots, spells, transition and long-run quantities.

    Half-life and mixing rate here come from the second eigenvalue of the chain, unlike
    the per-regime half-lives of :func:`chain_summary`; both are kept under own names.
    """
    keys = list(keys)
    n = states.groupBy(*keys).agg(
        F.count_if(F.col(state) == 1).alias("n_low"), F.count_if(F.col(state) == 2).alias("n_high")
    )

    def of(regime: str) -> Column:
        return F.when(F.col("regime") == regime, F.col("duration"))

    sp = spell_table.groupBy(*keys).agg(*[
        expr.alias(f"{name}_{r}")
        for r in ("low", "high")
        for name, expr in (("n_spells", F.count(of(r))), ("median_duration", F.median(of(r))), ("max_duration", F.max(of(r))))
    ])
    lam = F.abs(F.col("p11") + F.col("p22") - 1)
    inside = (lam > 0) & (lam < 1)
    out = n.join(sp, keys, "left").join(chain_summary(probs), keys, "left")
    if roots is not None:
        wide = roots.groupBy(*keys).agg(
            F.max(F.when(F.col("regime") == "low", F.col("rho"))).alias("rho_low"),
            F.max(F.when(F.col("regime") == "high", F.col("rho"))).alias("rho_high"),
        )
        out = out.join(wide, keys, "left")
    else:
        out = out.withColumns({"rho_low": F.lit(None).cast("double"), "rho_high": F.lit(None).cast("double")})
    total = F.col("n_low") + F.col("n_high")
    return out.select(
        *keys, "n_low", "n_high",
        F.try_divide("n_low", total).alias("share_low"), F.try_divide("n_high", total).alias("share_high"),
        "rho_low", "rho_high", "n_spells_low", "n_spells_high", "median_duration_low", "median_duration_high",
        "max_duration_low", "max_duration_high", "p11", "p12", "p21", "p22", "pi_low", "pi_high",
        "expected_low", "expected_high",
        F.when(inside, F.ln(F.lit(0.5)) / F.ln(lam)).alias("half_life_lambda2"),
        F.when(inside, 1 - lam).alias("mixing_rate"), "ergodic",
        (F.try_divide("n_low", total) - F.col("pi_low")).alias("delta_pi_low"),
        (F.try_divide("n_high", total) - F.col("pi_high")).alias("delta_pi_high"),
        (F.col("p11") > 0.98).alias("near_absorbing_low"), (F.col("p22") > 0.98).alias("near_absorbing_high"),
    )


def overlay_intervals(df: DataFrame, keys: Sequence[str] = ("index",), order: str = "date", state: str = "state") -> DataFrame:
    """Shaded intervals: each high row up to the next high row, the last one to itself."""
    over = W.partitionBy(*keys).orderBy(order)
    high = df.where(F.col(state) == 2)
    return high.select(*keys, F.col(order).alias("xmin"), F.coalesce(F.lead(order).over(over), F.col(order)).alias("xmax"))


def duration_histogram(spell_table: DataFrame, keys: Sequence[str] = ("index",), bins: int = 20) -> DataFrame:
    """Counts of durations per regime; bins are centred on a grid from the shortest to
    the longest duration of the path and closed on the right."""
    span = spell_table.groupBy(*keys).agg(F.min("duration").alias("_lo"), F.max("duration").alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins - 1))
    at = F.when(width > 0, F.ceil((F.col("duration") - F.col("_lo")) / width + 0.5 - 1e-9)).otherwise(1).cast("int")
    # A value is in the bin (centre - width/2, centre + width/2].
    return spell_table.join(span, list(keys)).groupBy(*keys, "regime", at.alias("bin")).agg(F.count("*").alias("n"))


def share_gap_by_variant(flags: DataFrame, a: str, b: str, variants: dict[str, Column], index: str = "index",
                         high: str = "high") -> DataFrame:
    """High share of two indices and its gap, per named row filter, in one pass."""
    def share(name: str, cond: Column) -> Column:
        return F.avg(F.when((F.col(index) == name) & cond, F.col(high).cast("double")))

    one = flags.agg(*[
        share(n, c).alias(f"{v}_{s}") for v, c in variants.items() for n, s in ((a, "a"), (b, "b"))
    ])
    rows = F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(f"{v}_a").alias("s_a"), F.col(f"{v}_b").alias("s_b"),
                 (F.col(f"{v}_a") - F.col(f"{v}_b")).alias("gap"))
        for v in variants
    ])
    return one.select(F.inline(rows))


def align_threshold(df: DataFrame, theta: DataFrame, keys: Sequence[str] = ("index",), value: str = "value") -> DataFrame:
    """Threshold in the units of the standardised driver; the driver's median if that
    falls outside its range.  ``theta`` has the keys and ``theta``."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    scaled = S.zscore(value, keys)
    spread = df.withColumn("_z", scaled).groupBy(*keys).agg(
        F.min("_z").alias("_lo"), F.max("_z").alias("_hi"), F.median("_z").alias("_mid")
    )
    z = F.when(F.col("_s") > 0, (F.col("theta") - F.col("_m")) / F.col("_s")).otherwise(F.col("theta"))
    outside = (F.col("_z") <= F.col("_lo")) | (F.col("_z") >= F.col("_hi"))
    return theta.join(stats, list(keys)).join(spread, list(keys)).withColumn("_z", z).select(
        *keys, "theta", F.when(outside, F.col("_mid")).otherwise(F.col("_z")).alias("theta_scaled"),
        F.when(outside, "scaled+median").otherwise("scaled").alias("space"),
    )


def fit_length(df: DataFrame, n_total: DataFrame, keys: Sequence[str] = ("index",), order: str = "t",
               value: str = "value") -> DataFrame:
    """Pad a path with NULL rows in front, or drop its oldest rows, to ``n_total`` rows per key."""
    back = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(order).desc()))
    tail = df.select(*keys, back.alias("_back"), value)
    slots = n_total.withColumn("_back", F.explode(F.sequence(F.lit(1), F.col("n_total"))))
    return slots.join(tail, [*keys, "_back"], "left").select(
        *keys, (F.col("n_total") - F.col("_back") + 1).alias(order), value
    )


def readiness(fits: DataFrame, states: DataFrame, responses: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Is a model complete: state count equals fitted rows, both states occur, horizon >= 2."""
    keys = list(keys)
    fitted = fits.groupBy(*keys).agg(F.sum("n_obs").alias("n_fit"), F.count_distinct("regime").alias("n_regimes"))
    path = states.where(F.col("state").isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n_state"), F.count_distinct("state").alias("n_states")
    )
    length = responses.groupBy(*keys).agg(F.max("h").alias("horizon"))
    joined = fitted.join(path, keys, "full").join(length, keys, "full")
    reason = (
        F.when(F.coalesce("n_regimes", F.lit(0)) < 2, "basic_schema")
        .when((F.coalesce("n_state", F.lit(0)) != F.coalesce("n_fit", F.lit(0))) | (F.coalesce("n_states", F.lit(0)) != 2), "regime_index")
        .when(F.coalesce("horizon", F.lit(0)) < 2, "irf_horizon")
        .otherwise("ready")
    )
    return joined.select(*keys, (reason == "ready").alias("ok"), reason.alias("reason"), "horizon")

