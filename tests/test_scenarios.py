"""Scenario, decomposition and score rules on small frames and the published tables."""

import math
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from stratawave.operators import contrib, scenarios, scores, shares
from stratawave.schemas import SCENARIO_SPEC
from stratawave.sources import readers, specs


def kernel(spark, values, unc="u", regime="low"):
    return spark.createDataFrame(
        [(unc, regime, i, r, h, v) for (i, r), vs in values.items() for h, v in enumerate(vs)],
        "uncertainty string, regime string, impulse string, response string, h int, value double")


def test_shocks_and_schedule_add_up(spark):
    spec = spark.createDataFrame([("s", "path", "low", 3, {"x": 1.0}, [("x", 1, 9, 0.5)], None, None, None, [])], SCENARIO_SPEC)
    got = {(r["t"], r["impulse"]): r["u"] for r in scenarios.input_grid(specs.with_defaults(spec)).collect()}
    assert got == {(1, "x"): 1.5, (2, "x"): 0.5, (3, "x"): 0.5}


def test_convolution_is_causal_and_cut_at_the_horizon(spark):
    u = spark.createDataFrame([("s", 3, 1, "x", 2.0), ("s", 3, 3, "x", 1.0), ("s", 3, 1, "z", 9.0)], "scenario string, horizon int, t int, impulse string, u double")
    out = scenarios.convolve(u, kernel(spark, {("x", "y"): [1.0, 0.5, 0.25, 9.0]}))
    assert {r["t"]: r["value"] for r in out.collect()} == {1: 2.0, 2: 1.0, 3: 1.5}


def test_all_regimes_and_zero_rows(spark):
    spec = spark.createDataFrame([("s", "path", "all", 2, {"x": 1.0}, [], None, None, None, [])], SCENARIO_SPEC)
    k = kernel(spark, {("x", "y"): [1.0], ("x", "w"): [0.0]}).unionByName(kernel(spark, {("x", "y"): [2.0]}, regime="high"))
    out = scenarios.run_scenarios(specs.with_defaults(spec), k)
    assert out.where("is_baseline").count() == out.where("not is_baseline").count() == 6
    got = {(r["regime"], r["variable"], r["t"]): r["value"] for r in out.where("not is_baseline").collect()}
    assert got[("low", "y", 1)] == 1.0 and got[("high", "y", 1)] == 2.0 and got[("low", "w", 2)] == 0.0


def test_band_of_many_draws(spark):
    df = spark.range(1000).select(F.lit("s").alias("scenario"), F.lit("v").alias("variable"), F.lit("low").alias("regime"),
                                  F.lit(1).alias("t"), F.lit(False).alias("is_baseline"), F.col("id").cast("double").alias("value"))
    r = scenarios.bands(df, [0.9], center="median").first()
    assert (r["value"], r["lo_90"], r["hi_90"]) == pytest.approx((499.5, 49.95, 949.05))


def tables(spark):
    delta = spark.createDataFrame([("s", "low", "y", t, d) for t, d in [(1, 1.0), (2, -0.5), (3, 0.0)]], "scenario string, regime string, variable string, t int, delta double")
    parts = spark.createDataFrame([("s", k, "low", "y", t, c) for k, t, c in [("a", 1, 0.6), ("b", 1, 0.2), ("a", 2, 0.1), ("b", 2, -0.1), ("a", 3, 0.0)]],
                                  "scenario string, shock_id string, regime string, variable string, t int, contribution double")
    return delta, parts


def test_residual_bucket(spark):
    delta, parts = tables(spark)
    rows = {(r["t"], r["shock_id"]): r["contribution"] for r in contrib.reconcile(parts, delta).collect()}
    assert rows[(1, "residual")] == pytest.approx(0.2) and rows[(2, "residual")] == pytest.approx(-0.5)
    assert (3, "residual") not in rows
    balance = contrib.mass_balance(contrib.reconcile(parts, delta), delta, include_residual=True)
    assert contrib.mass_report(balance).first()["ok"]


def test_proportional_scale_falls_back_to_a_residual(spark):
    delta, parts = tables(spark)
    rows = {(r["t"], r["shock_id"]): r["contribution"] for r in contrib.reconcile(parts, delta, "scale").collect()}
    assert rows[(1, "a")] == pytest.approx(0.75) and rows[(1, "b")] == pytest.approx(0.25)
    assert rows[(2, "residual")] == pytest.approx(-0.5)


def test_shapley_equals_all_orders(spark):
    deltas, weights = {"a": 1.0, "b": -2.0, "c": 0.5}, {"a": 2.0, "b": 1.0, "c": -1.0}
    single = spark.createDataFrame([(k, "low", "y", 1, v) for k, v in deltas.items()], "shock_id string, regime string, variable string, t int, delta double")
    smap = spark.createDataFrame([("s", k, w) for k, w in weights.items()], "scenario string, shock_id string, weight double")
    want = dict.fromkeys(deltas, 0.0)
    for order in permutations(deltas):
        total = 0.0
        for k in order:
            want[k] += ((total + weights[k] * deltas[k]) - total) / 6
            total += weights[k] * deltas[k]
    for found in (contrib.shapley(single, smap), contrib.shapley_sampled(single, smap, 20)):
        assert {r["shock_id"]: r["shapley"] for r in found.collect()} == pytest.approx(want)


def test_shapley_with_many_shocks(spark):
    single = spark.createDataFrame([(f"k{i}", "low", "y", t, float(i * t)) for i in range(12) for t in (1, 2)], "shock_id string, regime string, variable string, t int, delta double")
    smap = spark.createDataFrame([("s", f"k{i}", 0.5) for i in range(12)], "scenario string, shock_id string, weight double")
    got = {(r["shock_id"], r["t"]): r["shapley"] for r in contrib.shapley(single, smap).collect()}
    assert got == {(f"k{i}", t): 0.5 * i * t for i in range(12) for t in (1, 2)}


def test_last_step_of_each_scenario(spark):
    rows = [("s", 1, "a", 1.0), ("s", 2, "a", 3.0), ("s", 2, "b", 1.0), ("short", 1, "a", 2.0)]
    parts = spark.createDataFrame([(sc, "low", "y", t, k, v) for sc, t, k, v in rows], "scenario string, regime string, variable string, t int, shock_id string, contribution double")
    got = {r["scenario"]: r["herfindahl"] for r in contrib.concentration(parts, at="terminal").collect()}
    assert got == pytest.approx({"s": 0.625, "short": 1.0})


def test_waterfall_offsets(spark):
    parts = spark.createDataFrame([("s", k, "low", "y", 1, c) for k, c in [("a", 3.0), ("b", -1.0), ("c", 0.5), ("d", 0.25)]],
                                  "scenario string, shock_id string, regime string, variable string, t int, contribution double")
    bars = {r["shock_id"]: (r["y0"], r["y1"]) for r in contrib.waterfall(parts, top=2).collect()}
    assert bars == {"b": (0.0, -1.0), "Other": (-1.0, -0.25), "a": (-0.25, 2.75)}


# Published summary tables of the two indices.
SHARES = [
    ("vxo_vix", "L", "Energy", 12, 0.09524242298196402), ("vxo_vix", "L", "Industrial", 12, 0.36692891959134605),
    ("vxo_vix", "L", "Precious", 12, 0.18107968070144137), ("vxo_vix", "L", "Agriculture", 12, 0.35674897672524863),
    ("vxo_vix", "L", "Energy", 24, 0.09524242029817424), ("vxo_vix", "L", "Industrial", 24, 0.366928943377278),
    ("vxo_vix", "L", "Precious", 24, 0.18107969445925456), ("vxo_vix", "L", "Agriculture", 24, 0.3567489418652934),
    ("vxo_vix", "H", "Energy", 12, 0.13425346289490117), ("vxo_vix", "H", "Industrial", 12, 0.33319011413010946),
    ("vxo_vix", "H", "Precious", 12, 0.1804236884596767), ("vxo_vix", "H", "Agriculture", 12, 0.35213273451531274),
    ("vxo_vix", "H", "Energy", 24, 0.1573507684370844), ("vxo_vix", "H", "Industrial", 24, 0.30731426976162035),
    ("vxo_vix", "H", "Precious", 24, 0.17706016826240184), ("vxo_vix", "H", "Agriculture", 24, 0.35827479353889335),
    ("jln", "L", "Energy", 12, 0.10128985256109042), ("jln", "L", "Industrial", 12, 0.3633005394790786),
    ("jln", "L", "Precious", 12, 0.16370194405157043), ("jln", "L", "Agriculture", 12, 0.3717076639082607),
    ("jln", "L", "Energy", 24, 0.10128984977924702), ("jln", "L", "Industrial", 24, 0.36330054498009434),
    ("jln", "L", "Precious", 24, 0.16370194340988223), ("jln", "L", "Agriculture", 24, 0.3717076618307764),
    ("jln", "H", "Energy", 12, 0.09075993250836381), ("jln", "H", "Industrial", 12, 0.40471403320456667),
    ("jln", "H", "Precious", 12, 0.19540886482514072), ("jln", "H", "Agriculture", 12, 0.3091171694619288),
    ("jln", "H", "Energy", 24, 0.09082957473757833), ("jln", "H", "Industrial", 24, 0.40404443988408584),
    ("jln", "H", "Precious", 24, 0.19561050178213266), ("jln", "H", "Agriculture", 24, 0.30951548359620307),
]
HALF = [
    ("vxo_vix", "Agriculture", "H", 0.6783852300565313), ("vxo_vix", "Energy", "H", 0.5880878279714368),
    ("vxo_vix", "Industrial", "H", 0.5524554907173149), ("vxo_vix", "Precious", "H", 0.49440182297599933),
    ("jln", "Agriculture", "H", 0.6794204805314079), ("jln", "Energy", "H", 0.5661271414496795),
    ("jln", "Industrial", "H", 0.5969591334786066), ("jln", "Precious", "H", 0.7298906165825841),
]
PERSIST = [
    ("vxo_vix", "Agriculture", "H", 24, 1.633238295775115), ("vxo_vix", "Energy", "H", 24, 1.5099622574154214),
    ("vxo_vix", "Industrial", "H", 24, 1.6929242262335062), ("vxo_vix", "Precious", "H", 24, 1.4378273475100047),
    ("jln", "Agriculture", "H", 24, 1.0200164661371887), ("jln", "Energy", "H", 24, 1.2775763535475109),
    ("jln", "Industrial", "H", 24, 1.3239396326339692), ("jln", "Precious", "H", 24, 1.2501040935264127),
]
SELECTED = [
    ("1990-01 to 2025-06", "vxo_vix", 0.1635071090047393, 0.5960956449513823, 0.9819071909380312, 0.0089649829510342, 0.11146299592937514, "2025-08-27 19:53:17"),
    ("1986-2025", "vxo_vix", 0.156498673740053, 0.5783077773996887, 0.9704068170824304, 0.01431870440502203, 0.00907412543043317, "2025-08-27 19:53:26"),
    ("1986-2025", "jln", 0.15000000000000002, 0.5808543570024901, 0.8813104578078266, 0.0022409569104814286, 0.0012176638114778093, "2025-08-27 19:53:37"),
]


@pytest.fixture(scope="module")
def published(spark):
    return (
        spark.createDataFrame(SHARES, "proxy string, regime string, group string, horizon int, share double"),
        spark.createDataFrame(HALF, "proxy string, group string, regime string, half_life double"),
        spark.createDataFrame(PERSIST, "proxy string, group string, regime string, H int, PI double"),
        spark.createDataFrame(SELECTED, "window string, proxy string, s_H double, lambda_max_L double, lambda_max_H double, lb_p_L double, lb_p_H double, run_at string"),
    )


def test_published_wedges(published):
    for h, want in ((12, [0.0495, -0.0752, -0.0324, 0.0580]), (24, [0.0726, -0.1004, -0.0359, 0.0637])):
        got = {r["group"]: r["value"] for r in shares.share_wedge(published[0], h).collect()}
        assert [round(got[g], 4) for g in ("Energy", "Industrial", "Precious", "Agriculture")] == want


def test_published_marks(published):
    table = scores.robustness(scores.wedges(*published[:3]), published[3])
    got = {r["group"]: (r["dd"], r["horizon"], r["d_pi"], r["d_half_life"], r["diagnostics"], r["splice"]) for r in table.collect()}
    # The published marks.
    assert got == {
        "Energy": ("✓", "✓", "✓", "△", "△", "✓"), "Industrial": ("✓", "✓", "✓", "△", "△", "✓"),
        "Precious": ("✓", "✓", "✓", "✓", "△", "✓"), "Agriculture": ("✓", "✓", "✓", "✗", "△", "✓"),
    }


def test_spec_issues(spark):
    rows = [
        ("good", "path", "low", 12, {"x": 1.0}, [], None, None, None, []),
        ("bad", "girf", "sideways", 0, {"q": math.nan}, [(None, 1, 1, 1.0)], None, None, None, []),
    ]
    df = specs.with_defaults(spark.createDataFrame(rows, SCENARIO_SPEC))
    issues = specs.spec_issues(df, spark.createDataFrame([("x",)], "variable string")).collect()
    assert {r["name"] for r in issues} == {"bad"}
    what = {r["what"] for r in issues}
    assert {"horizon below 1", "unknown regime", "shock value not finite", "schedule item without impulse",
            "response scenario without impulse", "shocks uses unknown variable q"} <= what


def test_column_resolution():
    assert readers.resolve_columns(["observation_date", "VIXCLS"], "vix") == ("observation_date", "VIXCLS")
    assert readers.resolve_columns(["TIME PERIOD", "note", "x"], "other", ["x"]) == ("TIME PERIOD", "x")
    assert readers.resolve_columns(["date", "value"], "vix") == ("date", "value")
    with pytest.raises(ValueError):
        readers.resolve_columns(["a", "b"])


def test_bad_sheet_month_fails(spark):
    df = spark.createDataFrame([("1960M01", 1.0), ("1960X", 2.0)], "m string, p double")
    with pytest.raises(Exception, match="bad month"):
        readers.sheet_dates(df, "m").collect()


def test_given_horizon_stays(spark):
    spec = spark.createDataFrame([("long", 60), ("open", None)], "name string, horizon int").selectExpr("*", "'path' AS type", "'low' AS regime")
    assert {r["name"]: r["horizon"] for r in specs.with_defaults(spec).collect()} == {"long": 60, "open": 48}


def test_unknown_names_stop_or_keep_the_share(spark):
    basket = spark.createDataFrame([("s", "A", 1.0, 1.0), ("s", "ZZ", 1.0, 3.0)], "scenario string, impulse string, size double, weight double")
    model = spark.createDataFrame([("A",), ("B",)], "variable string")
    with pytest.raises(Exception, match="no variable of the model"):
        scenarios.shock_vector(basket, model).collect()
    assert [tuple(r) for r in scenarios.shock_vector(basket, model, unknown="drop").collect()] == [("s", "A", 0.25)]


def test_sizes_without_sigma_stay(spark):
    sizes = spark.createDataFrame([("A", 2.0), ("B", 1.0)], "variable string, size double")
    sigma = spark.createDataFrame([("A", "combined", 0.5)], "variable string, regime string, sigma double")
    got = {r["variable"]: r["scaled"] for r in scenarios.scale_by_sigma(sizes, sigma).collect()}
    assert got == {"A": 1.0, "B": None}


def test_grid_of_two_indices(spark):
    rows = [("vol", "s", "low", "A", 1, False, 1.0), ("macro", "s", "low", "A", 1, False, 2.0), ("macro", "s", "low", "A", 2, False, 3.0)]
    tidy = spark.createDataFrame(rows, "uncertainty string, scenario string, regime string, variable string, t int, is_baseline boolean, value double")
    got = {(r["uncertainty"], r["t"]): r["shocked"] for r in scenarios.assemble(tidy, fill_grid=True).collect()}
    assert got == {("vol", 1): 1.0, ("macro", 1): 2.0, ("macro", 2): 3.0}
