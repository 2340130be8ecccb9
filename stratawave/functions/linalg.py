"""Small dense algebra on one model at a time (K variables, p lags).

These run inside tasks on what Spark has aggregated: cross-product sums, fitted
coefficients, covariances.  None of them sees data rows of a series.
"""

from __future__ import annotations

import numpy as np


def solve_normal(gxx: np.ndarray, gxy: np.ndarray) -> np.ndarray:
    """Solution of the normal equations, single or stacked; least norm if singular."""
    try:
        return np.linalg.solve(gxx, gxy)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(gxx, hermitian=True) @ gxy


def residual_products(gram: np.ndarray, n_x: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and residual cross-products from sums of products of ``[x, y]``.

    ``gram`` is (..., M, M) with the k responses in the last rows; the first ``n_x``
    columns are the regressors used, so a shorter lag order is a sub-block.
    """
    gxx = gram[..., :n_x, :n_x]
    gxy = gram[..., :n_x, -k:]
    gyy = gram[..., -k:, -k:]
    b = solve_normal(gxx, gxy)
    return b, gyy - np.swapaxes(gxy, -1, -2) @ b


def information_criterion(rss: np.ndarray, n: np.ndarray, n_x: int, kind: str) -> np.ndarray:
    """n ln(RSS/n) plus penalty, summed over equations; infinite if a fit is exact."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        s2 = rss / n[..., None]
        penalty = n_x * np.log(n) if kind == "BIC" else np.full_like(n, 2.0 * n_x)
        out = (n[..., None] * np.log(s2) + penalty[..., None]).sum(-1)
    ok = np.all(np.isfinite(s2) & (s2 > 0), axis=-1) & np.isfinite(out) & (n > n_x)
    return np.where(ok, out, np.inf)


def split_lags(coef: np.ndarray, k: int, p: int) -> list[np.ndarray]:
    """Lag matrices from a (k, 1 + k p) coefficient table with the intercept first."""
    return [coef[:, 1 + m * k : 1 + (m + 1) * k] for m in range(p)]


def companion(lags: list[np.ndarray]) -> np.ndarray:
    k, p = lags[0].shape[0], len(lags)
    out = np.zeros((k * p, k * p))
    out[:k] = np.hstack(lags)
    out[k:, : k * (p - 1)] = np.eye(k * (p - 1))
    return out


def spectral_radius(lags: list[np.ndarray]) -> float:
    return float(np.abs(np.linalg.eigvals(companion(lags))).max())


def moving_average_matrices(lags: list[np.ndarray], horizon: int) -> np.ndarray:
    """Phi_0..Phi_H by powers of the companion matrix."""
    k = lags[0].shape[0]
    step = companion(lags)
    state = np.eye(len(step), k)
    out = np.empty((horizon + 1, k, k))
    for h in range(horizon + 1):
        out[h] = state[:k]
        state = step @ state
    return out


def log_det(sigma: np.ndarray, ridge: float = 1e-10) -> float:
    return float(np.log(np.maximum(np.linalg.eigvalsh(sigma), ridge)).sum())


def floor_eigenvalues(sigma: np.ndarray, floor: float) -> np.ndarray:
    s = (sigma + sigma.T) / 2
    w, v = np.linalg.eigh(np.where(np.isfinite(s), s, 0.0))
    if w.min() >= floor:
        return s
    s = (v * np.maximum(w, floor)) @ v.T
    return (s + s.T) / 2


def impact_matrix(sigma: np.ndarray, method: str, order: list[int] | None = None, shrink: float = 0.0,
                  floor: float = 1e-8, signs: list[tuple[int, int, int]] | None = None,
                  custom: np.ndarray | None = None) -> np.ndarray:
    """Impact matrix A.  ``cholesky`` is lower triangular in ``order`` with A A' = Sigma.

    ``sign`` flips a column when that satisfies more of the wanted (response, shock, sign).
    """
    k = len(sigma)
    if method == "unit":
        return np.eye(k)
    if method == "custom":
        return np.asarray(custom, dtype=float).reshape(k, k)
    if method not in ("cholesky", "sign"):
        raise ValueError(f"unknown identification {method!r}")
    order = list(range(k)) if order is None else order
    s = sigma[np.ix_(order, order)]
    if shrink:
        s = (1 - shrink) * s + shrink * np.diag(np.diag(s))
    a_ordered = np.linalg.cholesky(floor_eigenvalues(s, floor))
    a = np.empty_like(a_ordered)
    a[np.ix_(order, order)] = a_ordered
    for shock in {s for _, s, _ in signs or []} if method == "sign" else ():
        wanted = [(r, w) for r, s, w in signs if s == shock]
        score = [sum(np.sign(f * a[r, shock]) == w or (w == 0 and abs(a[r, shock]) < 1e-12) for r, w in wanted)
                 for f in (1, -1)]
        if score[1] > score[0]:
            a[:, shock] = 0.0 - a[:, shock]
    return a
