"""Fits, search, responses and diagnostics against direct numpy calculations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratawave.functions import linalg
from stratawave.functions.distributions import chi2_tail
from stratawave.operators import fit, responses

K, T, LAGS, DELAYS = 3, 260, [1, 2], [1, 2]
NAMES = ["a", "b", "c"]


def simulate(seed):
    rng = np.random.default_rng(seed)
    q = np.zeros(T)
    y = np.zeros((T, K))
    low = np.array([[0.5, 0.1, 0.0], [0.0, 0.3, 0.2], [0.1, 0.0, 0.4]])
    for t in range(1, T):
        q[t] = 0.7 * q[t - 1] + rng.normal()
        a = low if q[t - 1] <= 0.3 else -0.6 * low
        y[t] = a @ y[t - 1] + rng.normal(size=K)
    return y, np.round(q, 4)


@pytest.fixture(scope="module")
def data():
    return {f"m{s}": simulate(s) for s in (1, 2)}


@pytest.fixture(scope="module")
def vectors(spark, data):
    day = [dt.date(2000, 1, 1) + dt.timedelta(days=7 * t) for t in range(T)]
    rows = [(f"{m}_{n}", day[t], float(y[t, i])) for m, (y, _) in data.items() for i, n in enumerate(NAMES) for t in range(T)]
    returns = spark.createDataFrame(rows, "series string, date date, ret double")
    members = spark.createDataFrame([(m, f"{m}_{n}", i) for m in data for i, n in enumerate(NAMES)], "model string, series string, pos int")
    drivers = spark.createDataFrame([(m, day[t], float(q[t])) for m, (_, q) in data.items() for t in range(T)], "model string, date date, q double")
    return fit.model_vectors(returns, members, drivers, standardize=False).cache()


def lag_matrix(y, p, pmax):
    return np.hstack([np.ones((len(y) - pmax, 1))] + [y[pmax - m : len(y) - m] for m in range(1, p + 1)])


def brute_search(y, q, ngrid=20, trim=0.15, min_obs=30):
    pmax = max(LAGS)
    best = (math.inf,)
    for d in DELAYS:
        x = np.concatenate([np.full(d, np.nan), q[:-d]])[pmax:]
        keep = ~np.isnan(x)
        x = x[keep]
        grid = list(dict.fromkeys(np.quantile(x, np.linspace(trim, 1 - trim, ngrid), method="median_unbiased")))
        for theta in grid:
            low = x <= theta
            if min(low.mean(), 1 - low.mean()) < 0.15 or min(low.sum(), (~low).sum()) < min_obs:
                continue
            for p in LAGS:
                z, yy = lag_matrix(y, p, pmax)[keep], y[pmax:][keep]
                score = 0.0
                for side in (low, ~low):
                    b, *_ = np.linalg.lstsq(z[side], yy[side], rcond=None)
                    rss = ((yy[side] - z[side] @ b) ** 2).sum(0)
                    n = side.sum()
                    score += (n * np.log(rss / n) + z.shape[1] * np.log(n)).sum()
                if score < best[0]:
                    best = (score, p, d, theta, int(low.sum()), int((~low).sum()))
    return best


@pytest.fixture(scope="module")
def found(vectors):
    return fit.search_threshold(vectors, LAGS, DELAYS, ngrid=20).cache()


def test_search_equals_exhaustive_least_squares(data, found):
    for row in found.collect():
        score, p, d, theta, n_low, n_high = brute_search(*data[row["model"]])
        assert (row["p"], row["delay"], row["n_low"], row["n_high"]) == (p, d, n_low, n_high)
        assert row["theta"] == pytest.approx(theta, abs=1e-9)
        assert row["score"] == pytest.approx(score, rel=1e-9)


def test_search_reports_models_without_a_split(vectors):
    rows = fit.search_threshold(vectors, [1], [1], ngrid=5, min_obs=10_000).collect()
    assert all(r["theta"] is None and r["issue"] for r in rows)
    back = fit.search_with_fallback(vectors, [1], [1], ngrid=5, min_obs=10_000).collect()
    assert all(r["fallback"] and r["theta"] is not None for r in back)


@pytest.fixture(scope="module")
def fits(vectors, found):
    rows = fit.regime_rows(vectors, found, LAGS, DELAYS).cache()
    return rows, fit.ols(rows).cache()


def test_regime_fits(data, found, fits):
    rows, table = fits
    spec = {r["model"]: r for r in found.collect()}
    pmax = max(LAGS)
    for r in table.collect():
        y, q = data[r["model"]]
        s = spec[r["model"]]
        x = np.concatenate([np.full(s["delay"], np.nan), q[: -s["delay"]]])[pmax:]
        side = x <= s["theta"] if r["regime"] == "low" else x > s["theta"]
        z, yy = lag_matrix(y, s["p"], pmax)[side], y[pmax:][side]
        b, *_ = np.linalg.lstsq(z, yy, rcond=None)
        e = yy - z @ b
        np.testing.assert_allclose(np.reshape(r["b"], (K, -1)), b.T, atol=1e-9)
        np.testing.assert_allclose(np.reshape(r["sigma"], (K, K)), np.cov(e.T), atol=1e-9)
        np.testing.assert_allclose(r["r2"], 1 - (e**2).sum(0) / ((yy - yy.mean(0)) ** 2).sum(0), atol=1e-9)
        assert r["n_obs"] == side.sum()
    resid = fit.fitted(rows, table).agg(F.sum("resid")).first()[0]
    assert abs(resid) < 1e-6


def test_pooled_fit_and_covariance(data, vectors):
    table = fit.ols(fit.pooled_rows(vectors, 2), "resid").collect()
    for r in table:
        y, _ = data[r["model"]]
        z, yy = lag_matrix(y, 2, 2), y[2:]
        b, *_ = np.linalg.lstsq(z, yy, rcond=None)
        e = yy - z @ b
        np.testing.assert_allclose(np.reshape(r["sigma"], (K, K)), e.T @ e / (len(e) - 1 - 2 * K), atol=1e-9)
    cov = fit.covariances(vectors).where("model = 'm1'").collect()
    want = np.cov(data["m1"][0].T)
    for r in cov:
        assert r["value"] == pytest.approx(want[r["i"], r["j"]], abs=1e-9)


def test_stacked_residual_covariance(fits):
    rows, table = fits
    resid = fit.fitted(rows, table).toPandas()
    got = {r["model"]: np.reshape(r["sigma"], (K, K)) for r in fit.residual_covariance(table).collect()}
    for model, part in resid.groupby("model"):
        wide = part.pivot(index="t", columns="variable", values="resid")
        np.testing.assert_allclose(got[model], wide.cov().to_numpy(), atol=1e-8)


def test_responses_follow_the_recursion(fits):
    _, table = fits
    curves = responses.generalized(table, 6).toPandas()
    for r in table.collect():
        lags = linalg.split_lags(np.reshape(r["b"], (K, -1)), K, r["p"])
        phi = [np.eye(K)]
        for h in range(1, 7):
            phi.append(sum(phi[h - m] @ lags[m - 1] for m in range(1, min(r["p"], h) + 1)))
        cov = np.reshape(r["sigma"], (K, K))
        part = curves[(curves["model"] == r["model"]) & (curves["regime"] == r["regime"])].set_index(["h", "response", "impulse"])["value"]
        for h in range(7):
            want = phi[h] @ cov @ np.diag(1 / np.sqrt(np.diag(cov)))
            for i, a in enumerate(r["names"]):
                for j, b in enumerate(r["names"]):
                    assert part[(h, a, b)] == pytest.approx(want[i, j], abs=1e-9)


def test_shock_responses_start_one_step_late(fits):
    curves = responses.shock_responses(fits[1], 4, "unit").toPandas()
    assert sorted(curves["h"].unique()) == [0, 1, 2, 3, 4]
    assert (curves.loc[curves["h"] == 0, "value"] == 0).all()
    own = curves[(curves["h"] == 1) & (curves["impulse"] == curves["response"])]
    assert np.allclose(own["value"], 1.0)


@pytest.mark.parametrize("curve, expected", [
    ([1.0, 0.8, 0.4, 0.9, 0.1], 1 + 0.2 / 0.4), ([0.0, 2.0, 1.5, 1.2, 1.3], 2.0), ([1.0, 0.9, 0.8], None), ([0.0, 0.0, 0.0], 0.0),
])
def test_half_life_envelope(spark, curve, expected):
    df = spark.createDataFrame([("m", "low", "i", "r", h, v) for h, v in enumerate(curve)],
                               "model string, regime string, impulse string, response string, h int, value double")
    got = responses.half_life_envelope(df).first()["half_life"]
    assert got == pytest.approx(expected) if expected is not None else got is None


def mock_fit(spark, a11):
    a = [[a11, 0.1], [0.0, 0.4]]
    b = [0.0, *a[0], 0.0, *a[1]]
    return spark.createDataFrame([("mock", "low", ["oil", "value"], 2, 1, 30, b, [0.04, 0.0, 0.0, 0.09])],
                                 "model string, regime string, names array<string>, k int, p int, n_obs long, b array<double>, sigma array<double>")


def test_stability_of_the_mock_model(spark):
    stable = fit.stability(mock_fit(spark, 0.5)).first()
    assert stable["stable"] and stable["ok"] and stable["rho"] == pytest.approx(0.5)
    wild = fit.stability(mock_fit(spark, 1.05)).first()
    assert not wild["stable"] and wild["rho"] == pytest.approx(1.05)


def test_impact_matrices(spark):
    cov = spark.createDataFrame([("m", ["x", "y"], 2, [4.0, 1.0, 1.0, 3.0])], "model string, names array<string>, k int, sigma array<double>")
    a = np.reshape(fit.impact_matrices(cov, ordering=["y"]).first()["a"], (2, 2))
    np.testing.assert_allclose(a @ a.T, [[4, 1], [1, 3]])
    assert a[1, 0] == 0
    s = np.reshape(fit.impact_matrices(cov, "sign", signs=[("x", "x", "-")]).first()["a"], (2, 2))
    assert s[0, 0] == -2.0
    assert fit.identification_issues("sign", True, ["z"], ["x", "y"], [("x", "q", "*")])
    assert fit.identification_issues("cholesky", True, ["y"], ["x", "y"]) == []


def test_singular_covariance_is_repaired():
    a = linalg.impact_matrix(np.array([[1.0, 1.0], [1.0, 1.0]]), "cholesky")
    assert np.isfinite(a).all()


@pytest.mark.parametrize("x, df, p", [(3.841458820694124, 1, 0.05), (12.591587243743977, 6, 0.05), (21.02606981748307, 12, 0.05), (0.0, 3, 1.0), (1.0, 2, math.exp(-0.5))])
def test_chi2_tail(x, df, p):
    assert chi2_tail(x, df) == pytest.approx(p, rel=1e-9)
