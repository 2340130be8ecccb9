import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.functions.quantiles import exact_quantiles, grid_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
NAMES = [f"q{i}" for i in range(len(PROBS))]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key has most rows; its values repeat, are far apart and negative."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("key"),
        F.when(F.col("id") % 10 == 0, F.lit(5.0)).when(F.col("id") % 997 == 0, F.lit(1e9))
        .otherwise((F.hash("id") % 100_000) / 7.0).alias("v"),
    )
    return df


def test_matches_numpy_with_a_hot_key(skewed):
    got = {r["key"]: r for r in exact_quantiles(skewed, ["key"], "v", PROBS, NAMES, fine=4).collect()}
    data = skewed.toPandas()
    for key, part in data.groupby("key"):
        want = np.quantile(part["v"], PROBS)
        np.testing.assert_allclose([got[key][n] for n in NAMES], want, rtol=1e-12)


@pytest.mark.parametrize(("fine", "most", "few"), [(1, 100, 100_000), (1, 3, 0), (1024, 1 << 20, 0), (1, 1 << 20, 0)])
def test_parts_are_cut_until_they_are_small(skewed, fine, most, few):
    got = {r["key"]: r for r in exact_quantiles(skewed, ["key"], "v", PROBS, NAMES, fine=fine, most=most, few=few).collect()}
    for key, part in skewed.toPandas().groupby("key"):
        np.testing.assert_allclose([got[key][n] for n in NAMES], np.quantile(part["v"], PROBS), rtol=1e-12)


def test_moments_of_buckets(skewed):
    for r in exact_quantiles(skewed, ["key"], "v", [0.5], ["m"], moments=("mean", "sd")).collect():
        part = skewed.where(F.col("key") == r["key"]).toPandas()["v"]
        np.testing.assert_allclose([r["mean"], r["sd"]], [part.mean(), part.std()], rtol=1e-9)


def test_all_equal_and_nearly_equal(spark):
    same = spark.range(20_000).select(F.lit(-3.25).alias("v"))
    assert exact_quantiles(same, [], "v", [0.1, 0.5], ["a", "b"]).first()[:] == (-3.25, -3.25)
    near = spark.range(20_000).select((1e9 + F.col("id") * 1e-4).alias("v"))
    got = exact_quantiles(near, [], "v", PROBS, NAMES, most=50).first()
    np.testing.assert_allclose([got[n] for n in NAMES], np.quantile(near.toPandas()["v"], PROBS), rtol=1e-15)


def test_type8_and_no_key(skewed):
    row = exact_quantiles(skewed, [], "v", PROBS[1:-1], NAMES[1:-1], kind=8).collect()[0]
    want = np.quantile(skewed.toPandas()["v"], PROBS[1:-1], method="median_unbiased")
    np.testing.assert_allclose(list(row), want, rtol=1e-12)


def test_constant_and_single_values(spark):
    df = spark.createDataFrame([("a", 2.0)] * 5 + [("b", 7.0), ("c", None)], "key string, v double")
    got = {r["key"]: r["m"] for r in exact_quantiles(df, ["key"], "v", [0.5], ["m"]).collect()}
    assert got == {"a": 2.0, "b": 7.0}


def test_grid_type8(spark):
    values = [float(x) for x in np.random.default_rng(3).normal(size=101)]
    df = spark.createDataFrame([("s", v) for v in values], "key string, v double")
    probs = np.linspace(0.15, 0.85, 15)
    got = grid_quantiles(df, ["key"], "v", probs).collect()[0]["grid"]
    np.testing.assert_allclose(got, np.quantile(values, probs, method="median_unbiased"), rtol=1e-12)


def test_missing_and_infinite_values_do_not_count(spark):
    df = spark.createDataFrame([(x,) for x in (float("nan"), float("inf"), None, 1.0, 2.0, 3.0)], "v double")
    assert exact_quantiles(df, [], "v", [0.5], ["m"]).first()["m"] == 2.0


def test_values_over_many_powers_of_ten(spark):
    x = np.concatenate([10 ** np.linspace(-20, 20, 4001), -(10 ** np.linspace(-20, 20, 501)), np.zeros(9)])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = exact_quantiles(df, [], "v", PROBS, NAMES, fine=4).first()
    np.testing.assert_allclose([got[n] for n in NAMES], np.quantile(x, PROBS), rtol=1e-12)
