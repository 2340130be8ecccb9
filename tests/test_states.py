"""Literal vectors for states, spells and transitions, and brute force on random paths."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stratawave.functions import scalars
from stratawave.operators import aggregate, states


def path(spark, values, name="p"):
    start = dt.date(2000, 1, 1)
    rows = [(name, start + dt.timedelta(days=31 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "index string, date date, state int")


def durations(spark, values, **kw):
    rows = states.spells(path(spark, values), **kw).orderBy("spell_id").collect()
    return [(r["regime"], r["duration"]) for r in rows]


@pytest.mark.parametrize("values, expected", [
    ([1, 1, 1, 2, 2, 1, 2, 2, 2], [("low", 3), ("high", 2), ("low", 1), ("high", 3)]),
    ([1, 1, None, 2, 2, None, 1], [("low", 2), ("high", 2), ("low", 1)]),
    ([1, 1, 1, 2, 2, 2, 1, 1], [("low", 3), ("high", 3), ("low", 2)]),
    ([None, None, None], []),
])
def test_spells(spark, values, expected):
    assert durations(spark, values) == expected


def test_min_spell_joins_the_last_kept_spell(spark):
    assert durations(spark, [1, 1, 2, 1, 1, 1], min_spell=2) == [("low", 3), ("low", 3)]


def test_first_short_spell_is_kept(spark):
    assert durations(spark, [2, 1, 1, 1, None, 2, 1, 1], min_spell=2) == [("high", 1), ("low", 3), ("high", 1), ("low", 2)]


def test_spell_positions_and_dates(spark):
    first = states.spells(path(spark, [1, 1, 2, 2, 2])).orderBy("spell_id").first()
    assert (first["start_idx"], first["end_idx"], first["start_date"]) == (1, 2, dt.date(2000, 1, 1))


def test_text_labels(spark):
    df = path(spark, [1, 1, 2, 2, 1]).withColumn("state", F.when(F.col("state") == 1, "low").otherwise("high"))
    assert [(r["regime"], r["duration"]) for r in states.spells(df).orderBy("spell_id").collect()] == [("low", 2), ("high", 2), ("low", 1)]


def test_time_shares_sum_to_one(spark):
    rows = states.spell_summary(states.spells(path(spark, [1, 1, 1, 2, 2, 1, 2, 2, 2]))).collect()
    assert abs(sum(r["time_share"] for r in rows) - 1) < 1e-12


def test_spell_ids_are_null_at_missing_states(spark):
    df = path(spark, [1, 1, None, 2, 2, None, 1])
    ids = [r["spell_id"] for r in states.spell_ids(df, states.spells(df)).orderBy("date").collect()]
    assert ids == [1, 1, None, 2, 2, None, 3]


def brute_hysteresis(xs, theta, width):
    known = [x for x in xs if x is not None]
    if not known:
        return [1] * len(xs)
    mean = sum(known) / len(known)
    sd = (sum((x - mean) ** 2 for x in known) / (len(known) - 1)) ** 0.5 if len(known) > 1 else 1.0
    band = width * (sd or 1.0)
    out = []
    for i, x in enumerate(xs):
        if i == 0:
            out.append(1 if x is None or x <= theta else 2)
        elif x is None:
            out.append(out[-1])
        elif out[-1] == 1:
            out.append(2 if x > theta + band else 1)
        else:
            out.append(1 if x < theta - band else 2)
    return out


def brute_smooth(xs, m):
    runs = []
    for x in xs:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    lens = [r[1] for r in runs]
    vals = [r[0] for r in runs]
    n = len(runs)
    for i in range(n):
        if lens[i] >= m or n == 1:
            continue
        if i == 0:
            vals[i] = vals[1]
        elif i == n - 1:
            vals[i] = vals[i - 1]
        else:
            vals[i] = vals[i + 1] if lens[i + 1] >= lens[i - 1] else vals[i - 1]
    return [v for v, k in zip(vals, lens) for _ in range(k)]


def test_hysteresis_and_smoothing_on_random_paths(spark):
    rng = random.Random(5)
    rows, want_h, want_s = [], {}, {}
    for p in range(60):
        n = rng.randint(1, 40)
        xs = [None if rng.random() < 0.15 else rng.gauss(0, 1) for _ in range(n)]
        ss = [rng.choice([1, 2]) for _ in range(n)]
        want_h[f"p{p}"], want_s[f"p{p}"] = brute_hysteresis(xs, 0.1, 0.4), brute_smooth(ss, 3)
        rows += [(f"p{p}", i, x, s) for i, (x, s) in enumerate(zip(xs, ss))]
    df = spark.createDataFrame(rows, "index string, date int, value double, s int")
    out = states.hysteresis(df, F.lit(0.1), 0.4)
    out = states.smooth_short_spells(out, 3, state="s", out="smooth").orderBy("index", "date").collect()
    got_h, got_s = {}, {}
    for r in out:
        got_h.setdefault(r["index"], []).append(r["state"])
        got_s.setdefault(r["index"], []).append(r["smooth"])
    assert got_h == want_h
    assert got_s == want_s


def test_transitions_drop_pairs_with_a_missing_state(spark):
    df = path(spark, [1, 1, None, 2, 2, 1])
    r = states.transition_probs(states.transition_counts(df)).first()
    assert (r["n11"], r["n12"], r["n21"], r["n22"]) == (1, 0, 1, 1)
    s = states.transition_counts(df, skip_null_rows=True).first()
    assert (s["n11"], s["n12"], s["n21"], s["n22"]) == (1, 1, 1, 1)


def test_bootstrap_repeats_and_covers(spark):
    rng = random.Random(2)
    values = [1]
    for _ in range(299):
        values.append(values[-1] if rng.random() < 0.9 else 3 - values[-1])
    df = path(spark, values)
    a = states.bootstrap_transitions(df, 4, draws=300).orderBy("param").collect()
    b = states.bootstrap_transitions(df.repartition(5), 4, draws=300).orderBy("param").collect()
    assert a == b
    p = states.transition_probs(states.transition_counts(df)).first()
    for row in a:
        assert row["n_draws"] == 300 and row["lo"] < p[row["param"]] < row["hi"]


def test_index_names(spark):
    names = {"vix index": "VIX", "VIXINDEX": "VIX", "jlnum12m": "JLN", "JLNum3M": "JLN", "CISS_Index": "CISS",
             "ecbciss": "CISS", "something": "something"}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", scalars.index_name(F.col("n")).alias("c"))
    assert {r["n"]: r["c"] for r in df.collect()} == names


def test_flag_overlap_counts_each_date_once(spark):
    flags = spark.createDataFrame(
        [(d, i, h) for d, a, b in [(1, 1, 1), (2, 1, 0), (3, 0, 1), (4, None, 1), (5, 0, 0)] for i, h in (("a", a), ("b", b))] + [(6, "a", 1)],
        "date int, index string, high int")
    r = aggregate.flag_overlap(flags, "a", "b").first()
    assert (r["both_high"], r["any_high"], r["jaccard"]) == (1, 4, 0.25)
