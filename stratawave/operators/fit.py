"""Lag models per regime, for many models in one job.

The data pass is Spark's: complete rows, lags, driver delays and regimes are
windows over one model's path (one row per calendar step), and the sums of products
of each (model, regime or threshold bin) are partial sums per Arrow batch.  Only the
sums meet in one place, where a K p + 1 square system is solved per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratawave.functions import linalg
from stratawave.functions.distributions import P_FLOOR, chi2_tail_udf
from stratawave.functions.quantiles import grid_quantiles
from stratawave.operators import series as S
from stratawave.operators.joins import salted_join
from stratawave.schemas import struct

# ---------------------------------------------------------------- design rows


def model_vectors(returns: DataFrame, members: DataFrame, drivers: DataFrame, standardize: bool = True,
                  smooth: int = 1, value: str = "ret") -> DataFrame:
    """Complete rows per model: ``(model, names, date, t, y, q)``.

    ``members`` is ``(model, series, pos)``, ``drivers`` ``(model, date, q)``.  A date is
    kept if every member and the driver have a value; standardising and smoothing of
    the driver follow on the kept rows.
    """
    counted = members.withColumn("_k", F.count("*").over(W.partitionBy("model")))
    long = salted_join(returns.where(F.col(value).isNotNull()), counted, ["series"], ["date"], salt=8)
    long = long.join(drivers.where(F.col("q").isNotNull()), ["model", "date"])
    long = long.withColumn("_n", F.count("*").over(W.partitionBy("model", "date"))).where(F.col("_n") == F.col("_k"))
    if standardize:
        long = long.withColumn(value, S.zscore(value, ["model", "pos"], flat="one"))
    cells = F.sort_array(F.collect_list(F.struct("pos", "series", value)))
    vectors = long.groupBy("model", "date", "q").agg(cells.alias("_c")).select(
        "model", F.transform("_c", lambda c: c["series"]).alias("names"), "date",
        F.transform("_c", lambda c: c[value]).alias("y"), "q",
    )
    if smooth > 1:
        vectors = vectors.withColumn("q", S.moving_average("q", smooth, ["model"]))
    return vectors.select("model", "names", "date", F.row_number().over(S.ordered(["model"])).alias("t"), "y", "q")


def design(vectors: DataFrame, lags: int, delays: Sequence[int] = ()) -> DataFrame:
    """Rows ``t > lags`` with ``x = [1, y_{t-1}, .., y_{t-p}]`` and the delayed drivers ``xq``."""
    over = S.ordered(["model"], "t")
    x = F.concat(F.array(F.lit(1.0)), *[F.lag("y", m).over(over) for m in range(1, lags + 1)])
    xq = F.array(*[F.lag("q", d).over(over) for d in delays]) if delays else F.array().cast("array<double>")
    return vectors.select("model", "names", "date", "t", "y", x.alias("x"), xq.alias("xq")).where(F.col("t") > lags)


def lag_columns(k: Column, p: Column) -> Column:
    """Number of regressors with intercept."""
    return (k * p + 1).cast("int")


# --------------------------------------------------------- sums of products


#: Bytes of sums that a task holds before it hands them on.
HELD = 64 << 20


def product_sums(rows: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Partial sums of ``z z'`` per key, no shuffle: one row per key and task, more only where a task's sums
    would take more than ``HELD`` bytes.

    ``rows`` has the keys and ``z ARRAY<DOUBLE>``; the result has ``m`` and the flat
    ``gram`` of length m * m.  :func:`total_products` adds the parts.  Columns in
    ``carry`` are constant within a key and are kept.
    """
    keys, carry = list(keys), list(carry)
    schema = rows.select(*keys, *carry).schema.add("m", T.IntegerType()).add("gram", T.ArrayType(T.DoubleType()))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}
        held = 0

        def out() -> pd.DataFrame:
            table = pd.DataFrame([[*key, *rest, gram.ravel()] for key, (*rest, gram) in sums.items()], columns=[*keys, *carry, "m", "gram"])
            sums.clear()
            return table

        for batch in batches:
            for key, part in batch.groupby(keys, sort=False, dropna=False):
                z = np.vstack(part["z"].to_numpy())
                if key in sums:
                    sums[key][-1] += z.T @ z
                    continue
                sums[key] = [*(part[c].iloc[0] for c in carry), z.shape[1], z.T @ z]
                held += 8 * z.shape[1] ** 2
                if held > HELD:
                    yield out()
                    held = 0
        if sums:
            yield out()

    return rows.select(*keys, *carry, "z").mapInPandas(partial, schema)


def total_products(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of partial products as long rows ``(keys, i, j, value)`` with 0-based positions."""
    cells = parts.select(*keys, "m", F.posexplode("gram").alias("_at", "_v"))
    return cells.groupBy(*keys, "m", "_at").agg(F.sum("_v").alias("value")).select(
        *keys, F.floor(F.col("_at") / F.col("m")).cast("int").alias("i"),
        (F.col("_at") % F.col("m")).cast("int").alias("j"), "value",
    )


def covariances(vectors: DataFrame, keys: Sequence[str] = ("model",), y: str = "y") -> DataFrame:
    """Sample covariance of the vector columns: ``(keys, i, j, value, n)``, 0-based.

    The summed products of a model are one array (its size is that of the model), so
    means and cross-products meet without a join.
    """
    rows = vectors.select(*keys, F.concat(F.array(F.lit(1.0)), F.col(y)).alias("z"))
    sums = total_products(product_sums(rows, keys), keys)
    flat = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "value"))).alias("_g"))
    m = F.sqrt(F.size("_g")).cast("int")
    n = F.col("_g")[0]["value"]
    cov = F.transform("_g", lambda c: F.struct(
        (c["i"] - 1).alias("i"), (c["j"] - 1).alias("j"),
        ((c["value"] - F.get("_g", c["i"] * m)["value"] * F.get("_g", c["j"])["value"] / n) / (n - 1)).alias("value"),
        n.alias("n"),
    ))
    return flat.select(*keys, F.inline(F.filter(cov, lambda c: (c["i"] >= 0) & (c["j"] >= 0))))


# --------------------------------------------------------- threshold search

_SEARCH = (
    "model string, p int, delay int, theta double, score double, share_low double, share_high double, "
    "n_low long, n_high long, issue string"
)


_SCORED = _SEARCH.rsplit(", ", 1)[0]


def threshold_candidates(rows: DataFrame, delays: Sequence[int], trim: float, ngrid: int,
                         grid: str = "quantile") -> tuple[DataFrame, DataFrame]:
    """Rows per (model, delay) with their driver, and the candidate thresholds.

    ``quantile`` takes distinct type-8 quantiles between trim and 1 - trim;
    ``linear`` spaces ``ngrid`` points evenly between those two quantiles.
    """
    names = F.array(*[F.lit(int(d)) for d in delays])
    long = rows.select("model", "y", "x", F.posexplode("xq").alias("_d", "q")).where(F.col("q").isNotNull())
    long = long.withColumn("delay", F.get(names, F.col("_d"))).drop("_d")
    if grid == "quantile":
        probs = np.linspace(trim, 1 - trim, ngrid)
        grids = grid_quantiles(long, ["model", "delay"], "q", probs, kind=8)
        return long, grids.select("model", "delay", F.array_distinct("grid").alias("grid"))
    ends = grid_quantiles(long, ["model", "delay"], "q", [trim, 1 - trim], kind=8)
    lo, hi = F.element_at("grid", 1), F.element_at("grid", 2)
    steps = max(2, ngrid)
    points = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: lo + (hi - lo) * i / (steps - 1))
    return long, ends.where(lo < hi).select("model", "delay", points.alias("grid"))


def search_threshold(vectors: DataFrame, lags: Sequence[int], delays: Sequence[int], trim: float = 0.15,
                     ngrid: int = 100, criterion: str = "BIC", min_share: float = 0.15, min_obs: int = 30,
                     grid: str = "quantile", given: DataFrame | None = None) -> DataFrame:
    """Best (delay, threshold, lag order) of every model.

    A row falls into the bin of the number of candidates below its driver, and the products of a bin are one
    matrix, added up within each task.  A (model, delay) is then one stream of parts in the order of its bins: their
    prefix sums are the products of the low regime at every candidate, and the rest are those of the high
    regime.  That task holds a matrix for each candidate, whatever the number of rows.  The winner of a model is a
    minimum over its scored candidates.  Lag order p uses the leading block of the largest order, on the same rows.
    Equal scores go to the earlier delay, then the smaller threshold, then the earlier lag order.
    ``given`` (model, theta) replaces the search of the threshold.
    """
    pmax = max(lags)
    lags, delays = [int(p) for p in lags], [int(d) for d in delays]
    rows = design(vectors, pmax, delays)
    long, grids = threshold_candidates(rows, delays, trim, ngrid, grid)
    if given is not None:
        grids = given.select("model", F.explode(F.array(*[F.lit(d) for d in delays])).alias("delay"),
                             F.array(F.col("theta").cast("double")).alias("grid"))
    bin_ = F.size(F.filter("grid", lambda g: g < F.col("q")))
    binned = long.join(grids, ["model", "delay"]).select(
        "model", "delay", bin_.alias("bin"), F.get("grid", bin_).alias("theta"), F.concat("x", "y").alias("z"), F.size("y").alias("k"),
    )
    parts = product_sums(binned, ["model", "delay", "bin"], ["theta", "k"])
    ordered = parts.repartition("model", "delay").sortWithinPartitions("model", "delay", "bin")
    scored = ordered.mapInPandas(_scored(lags, criterion, min_share, min_obs), _SCORED)
    order = F.array_position(F.array(*[F.lit(d) for d in delays]), F.col("delay"))
    first = F.array_position(F.array(*[F.lit(p) for p in lags]), F.col("p"))
    ranked = F.struct("score", order.alias("_d"), "theta", first.alias("_p"), "p", "delay", "share_low", "share_high", "n_low", "n_high")
    best = scored.groupBy("model").agg(F.min(F.when(F.col("score").isNotNull(), ranked)).alias("_b")).select("model", "_b.*")
    names = [f.split()[0] for f in _SEARCH.split(", ")]
    return best.withColumn("issue", F.when(F.col("score").isNull(), F.lit("no admissible threshold"))).select(*names)


def _scored(lags: list[int], criterion: str, min_share: float, min_obs: int):
    """Function for mapInPandas over parts in order: the admissible candidates of each (model, delay) with their
    score at each lag order, or one row without a score."""
    columns = [f.split()[0] for f in _SCORED.split(", ")]
    types = {"p": "Int32", "delay": "Int32", "n_low": "Int64", "n_high": "Int64"}

    def candidates(group: tuple, theta: list, sums: list[np.ndarray]) -> list[list]:
        model, delay, k, m = group
        upto = np.cumsum(np.array(sums), axis=0).reshape(-1, m, m)
        real = np.array([t is not None and t == t for t in theta])  # the rows above the last candidate belong to no split
        low = upto[real]
        high = upto[-1] - low
        theta = [t for t, r in zip(theta, real, strict=True) if r]
        n_low, n_high = np.rint(low[:, 0, 0]), np.rint(high[:, 0, 0])
        share = n_low / (n_low + n_high)
        at = np.flatnonzero((share >= min_share) & (1 - share >= min_share) & (n_low >= min_obs) & (n_high >= min_obs))
        out = []
        for p in lags if len(at) else ():
            score = np.zeros(len(at))
            for gram, n in ((low[at], n_low[at]), (high[at], n_high[at])):
                _, ssp = linalg.residual_products(gram, 1 + k * p, k)
                score = score + linalg.information_criterion(np.diagonal(ssp, axis1=1, axis2=2), n, 1 + k * p, criterion)
            out += [[model, p, delay, float(theta[g]), float(x), float(share[g]), float(1 - share[g]), int(n_low[g]), int(n_high[g])]
                    for g, x in zip(at, score, strict=True) if np.isfinite(x)]
        return out or [[model, None, delay, None, None, None, None, None, None]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, bins, theta, sums = None, [], [], []
        for batch in batches:
            out = []
            for model, delay, bin_, t, k, m, gram in batch[["model", "delay", "bin", "theta", "k", "m", "gram"]].itertuples(index=False, name=None):
                if (model, delay, k, m) != current:
                    out += candidates(current, theta, sums) if current else []
                    current, bins, theta, sums = (model, delay, k, m), [], [], []
                if bins and bins[-1] == bin_:
                    sums[-1] = sums[-1] + gram
                else:
                    bins.append(bin_)
                    theta.append(t)
                    sums.append(gram)
            if out:
                yield pd.DataFrame(out, columns=columns).astype(types)
        if current:
            yield pd.DataFrame(candidates(current, theta, sums), columns=columns).astype(types)

    return run


def search_with_fallback(vectors: DataFrame, lags: Sequence[int], delays: Sequence[int], smooth: int = 1,
                         **options) -> DataFrame:
    """Evenly spaced search on the smoothed driver; without a valid split the median of
    the driver delayed by the first delay, at the first lag order."""
    if smooth > 1:
        vectors = vectors.withColumn("q", S.moving_average("q", smooth, ["model"]))
    found = search_threshold(vectors, lags, delays, grid="linear", **{"min_obs": 5, **options})
    delayed = vectors.withColumn("_x", F.lag("q", delays[0]).over(S.ordered(["model"], "t")))
    middle = delayed.groupBy("model").agg(F.median("_x").alias("_mid"))
    shares = delayed.join(middle, "model").where(F.col("_x").isNotNull()).groupBy("model", "_mid").agg(
        F.avg((F.col("_x") <= F.col("_mid")).cast("double")).alias("_low")
    )
    none = F.col("issue").isNotNull() | F.col("theta").isNull()
    return shares.join(found, "model", "left").select(
        "model",
        F.when(none, F.lit(int(lags[0]))).otherwise(F.col("p")).alias("p"),
        F.when(none, F.lit(int(delays[0]))).otherwise(F.col("delay")).alias("delay"),
        F.when(none, F.col("_mid")).otherwise(F.col("theta")).alias("theta"), "score",
        F.when(none, F.col("_low")).otherwise(F.col("share_low")).alias("share_low"),
        F.when(none, 1 - F.col("_low")).otherwise(F.col("share_high")).alias("share_high"),
        none.alias("fallback"),
    )


# ------------------------------------------------------------------- fits

_FIT = (
    "model string, regime string, names array<string>, k int, p int, n_obs long, b array<double>, sigma array<double>, "
    "rss array<double>, r2 array<double>, aic array<double>, bic array<double>"
)


def regime_rows(vectors: DataFrame, spec: DataFrame, lags: Sequence[int], delays: Sequence[int]) -> DataFrame:
    """Design rows of every model at its selected order, delay and threshold.

    ``lags`` and ``delays`` are those of the search, so the sample is the same.
    ``spec`` has ``model, p, delay, theta``.
    """
    rows = design(vectors, max(lags), list(delays))
    names = F.array(*[F.lit(int(d)) for d in delays])
    picked = rows.join(spec.select("model", "p", "delay", "theta"), "model").withColumn(
        "q", F.element_at("xq", F.array_position(names, F.col("delay")).cast("int"))
    ).where(F.col("q").isNotNull())
    used = F.slice("x", F.lit(1), lag_columns(F.size("y"), F.col("p")))
    regime = F.when(F.col("q") <= F.col("theta"), "low").otherwise("high")
    return picked.select("model", "names", "date", "t", "p", "q", regime.alias("regime"), "y", used.alias("x"))


def pooled_rows(vectors: DataFrame, lags: int) -> DataFrame:
    """Design rows without a split (regime ``pooled``)."""
    return design(vectors, lags).select(
        "model", "names", "date", "t", F.lit(lags).alias("p"), F.lit(None).cast("double").alias("q"),
        F.lit("pooled").alias("regime"), "y", "x",
    )


def ols(rows: DataFrame, sigma_df: str = "n-1") -> DataFrame:
    """Least squares per (model, regime) from the summed products.

    One row per fit with flat arrays: ``b`` (k rows of intercept and lags), ``sigma``,
    ``rss``, ``r2``, ``aic``, ``bic``.  ``sigma_df`` divides the residual products by
    n - 1 or, with ``"resid"``, by n - 1 - k p.
    """
    keyed = rows.select("model", "regime", "names", F.size("y").alias("k"), "p", F.concat("x", "y").alias("z"))
    parts = product_sums(keyed, ["model", "regime", "k", "p"], carry=["names"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        k, p, m = (int(pdf[c].iloc[0]) for c in ("k", "p", "m"))
        gram = np.vstack(pdf["gram"].to_numpy()).sum(axis=0).reshape(m, m)
        n, n_x = gram[0, 0], 1 + k * p
        b, ssp = linalg.residual_products(gram, n_x, k)
        rss = np.diag(ssp)
        sst = np.diag(gram)[-k:] - gram[0, -k:] ** 2 / n
        with np.errstate(divide="ignore", invalid="ignore"):
            fit_term = n * np.log(rss / n)
            r2 = np.where(sst > 0, 1 - rss / sst, np.nan)
        divisor = n - 1 if sigma_df == "n-1" else n - n_x
        return pd.DataFrame([{
            "model": pdf["model"].iloc[0], "regime": pdf["regime"].iloc[0], "names": pdf["names"].iloc[0], "k": k, "p": p, "n_obs": int(round(n)),
            "b": b.T.ravel(), "sigma": (ssp / divisor).ravel(), "rss": rss, "r2": r2,
            "aic": fit_term + 2 * n_x, "bic": fit_term + n_x * np.log(n),
        }])

    return parts.groupBy("model", "regime").applyInPandas(fit, _FIT)


def coefficients(fits: DataFrame) -> DataFrame:
    """Long coefficients ``(model, regime, equation, regressor, lag, value)``; the intercept has lag 0."""
    n_x = lag_columns(F.col("k"), F.col("p"))
    cells = fits.select("model", "regime", "names", "k", n_x.alias("_m"), F.posexplode("b").alias("_at", "value"))
    col = F.col("_at") % F.col("_m")
    lagged = col > 0
    return cells.select(
        "model", "regime",
        F.get("names", F.floor(F.col("_at") / F.col("_m")).cast("int")).alias("equation"),
        F.when(lagged, F.get("names", ((col - 1) % F.col("k")).cast("int"))).otherwise("intercept").alias("regressor"),
        F.when(lagged, F.floor((col - 1) / F.col("k")) + 1).otherwise(0).cast("int").alias("lag"),
        "value",
    )


def square_table(fits: DataFrame, column: str = "sigma", keys: Sequence[str] = ("model", "regime")) -> DataFrame:
    """A flat k x k array column as long rows ``(keys, i, j, value)`` with names."""
    cells = fits.select(*keys, "names", "k", F.posexplode(column).alias("_at", "value"))
    return cells.select(
        *keys,
        F.get("names", F.floor(F.col("_at") / F.col("k")).cast("int")).alias("i"),
        F.get("names", (F.col("_at") % F.col("k")).cast("int")).alias("j"), "value",
    )


def equation_table(fits: DataFrame) -> DataFrame:
    """Fit statistics per equation: ``(model, regime, equation, n_obs, rss, r2, aic, bic)``."""
    zipped = F.arrays_zip(F.col("names").alias("equation"), "rss", "r2", "aic", "bic")
    return fits.select("model", "regime", "n_obs", F.inline(zipped)).select(
        "model", "regime", "equation", "n_obs", "rss", "r2", "aic", "bic"
    )


def fitted(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Actual, fitted and residual per row and variable, without leaving the JVM."""
    joined = rows.join(fits.select("model", "regime", "b"), ["model", "regime"])
    n_x = F.size("x")

    def predict(i: Column) -> Column:
        beta = F.slice("b", i * n_x + 1, n_x)
        return F.aggregate(F.zip_with(beta, "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    hat = F.transform(F.sequence(F.lit(0), F.size("y") - 1), predict)
    zipped = F.arrays_zip(F.col("names").alias("variable"), F.col("y").alias("y"), hat.alias("yhat"))
    return joined.select("model", "regime", "date", "t", F.inline(zipped)).withColumn("resid", F.col("y") - F.col("yhat"))


def fit_quality(fit_table: DataFrame) -> DataFrame:
    """R² per model, regime and variable from the fitted table."""
    keys = ["model", "regime", "variable"]
    return fit_table.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum(F.pow("resid", F.lit(2.0))).alias("rss"),
        (F.var_pop("y") * F.count("*")).alias("sst"),
    ).withColumn("r2", F.when(F.col("sst") > 0, 1 - F.col("rss") / F.col("sst")))


# ------------------------------------------------------------- diagnostics


def _matrices(b, sigma, k, p):
    n_x = 1 + k * p
    return linalg.split_lags(np.asarray(b, float).reshape(k, n_x), k, p), np.asarray(sigma, float).reshape(k, k)


@F.pandas_udf(struct(rho=T.DoubleType(), sigma_pd=T.BooleanType(), log_det=T.DoubleType()))
def _checks(b: pd.Series, sigma: pd.Series, k: pd.Series, p: pd.Series) -> pd.DataFrame:
    out = []
    for bb, ss, kk, pp in zip(b, sigma, k, p):
        lags, cov = _matrices(bb, ss, int(kk), int(pp))
        out.append((linalg.spectral_radius(lags), bool(np.linalg.eigvalsh(cov).min() > 0), linalg.log_det(cov)))
    return pd.DataFrame(out, columns=["rho", "sigma_pd", "log_det"])


def stability(fits: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Spectral radius, positive definite covariance and enough rows per fit."""
    rows = fits.withColumn("_c", _checks("b", "sigma", "k", "p"))
    need = F.greatest(F.lit(10), F.col("k") * F.col("p") + 5)
    return rows.select(
        "model", "regime", "n_obs", "k", "p", F.col("_c.rho").alias("rho"), (F.col("_c.rho") < 1).alias("stable"),
        F.col("_c.sigma_pd").alias("sigma_pd"), F.col("_c.log_det").alias("log_det"),
        (F.col("n_obs") >= need).alias("enough_obs"),
        (F.col("_c.sigma_pd") & (F.col("_c.rho") < 1 - tol) & (F.col("n_obs") >= need)).alias("ok"),
    )


def ljung_box(fit_table: DataFrame, max_lag: int = 12) -> DataFrame:
    """Whiteness of residuals: Ljung-Box per variable and the smallest p per fit.

    The number of lags is min(12, n/4), at least 4.  A path's rows are numbered inside
    its regime, as the rows of a regime form one sequence.
    """
    keys = ["model", "regime", "variable"]
    over = W.partitionBy(*keys).orderBy("t")
    centred = fit_table.withColumn("_e", F.col("resid") - F.avg("resid").over(W.partitionBy(*keys)))
    centred = centred.withColumns({f"_l{m}": F.lag("_e", m).over(over) for m in range(1, max_lag + 1)})
    acc = centred.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("_e") * F.col("_e")).alias("_c0"),
        *[F.sum(F.col("_e") * F.col(f"_l{m}")).alias(f"_c{m}") for m in range(1, max_lag + 1)],
    )
    lag = F.greatest(F.lit(4), F.least(F.lit(max_lag), F.floor(F.col("n") / 4).cast("int")))
    terms = [
        F.when(lag >= m, F.pow(F.col(f"_c{m}") / F.col("_c0"), F.lit(2.0)) / (F.col("n") - m)).otherwise(0.0)
        for m in range(1, max_lag + 1)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    valid = (F.col("n") >= 10) & (F.col("_c0") > 0) & (F.col("n") > lag + 1)
    q = F.when(valid, F.col("n") * (F.col("n") + 2) * total)
    return acc.select(*keys, "n", lag.alias("lag"), q.alias("q")).withColumn(
        "p", chi2_tail_udf(F.col("q"), F.col("lag").cast("double"))
    )


def min_whiteness(box: DataFrame) -> DataFrame:
    return box.groupBy("model", "regime").agg(F.min("p").alias("lb_p"))


def split_contrast(split_checks: DataFrame, pooled_checks: DataFrame) -> DataFrame:
    """Likelihood contrast of the split against one regime: ``(model, stat, df, p)``.

    Doubles the difference of the full log-determinants weighted by their rows; the two
    sides use their own covariance divisors.
    """
    split = split_checks.groupBy("model").agg(
        F.sum(-F.col("n_obs") * F.col("log_det")).alias("_split"), F.first("k").alias("k"), F.first("p").alias("p")
    )
    pooled = pooled_checks.select("model", (-F.col("n_obs") * F.col("log_det")).alias("_pool"))
    out = split.join(pooled, "model").select(
        "model", (2 * (F.col("_split") - F.col("_pool"))).alias("stat"), (F.col("k") * (F.col("k") * F.col("p") + 1)).alias("df")
    )
    tail = chi2_tail_udf(F.col("stat"), F.col("df").cast("double"))
    return out.withColumn("p", F.when(F.col("stat") >= 0, F.greatest(tail, F.lit(P_FLOOR))))


def selection_summary(spec: DataFrame, checks: DataFrame, whiteness: DataFrame, contrast: DataFrame) -> DataFrame:
    """One row per model: order, delay, threshold, sizes, roots, whiteness, contrast."""
    def side(regime: str, column: str) -> Column:
        return F.max(F.when(F.col("regime") == regime, F.col(column)))

    pieces = checks.join(whiteness, ["model", "regime"], "left").groupBy("model").agg(
        side("low", "n_obs").alias("T_L"), side("high", "n_obs").alias("T_H"),
        side("low", "rho").alias("lambda_max_L"), side("high", "rho").alias("lambda_max_H"),
        side("low", "lb_p").alias("lb_p_L"), side("high", "lb_p").alias("lb_p_H"),
    )
    return spec.select("model", "p", F.col("delay").alias("d"), F.col("theta").alias("c_star"), F.col("share_high").alias("s_H")) \
        .join(pieces, "model").join(contrast.select("model", F.col("stat").alias("contrast_stat"), F.col("p").alias("contrast_p")), "model", "left") \
        .select("model", "p", "d", "c_star", "T_L", "T_H", "s_H", "lambda_max_L", "lambda_max_H", "lb_p_L", "lb_p_H",
                "contrast_stat", "contrast_p")


def model_registry(spec: DataFrame, checks: DataFrame) -> DataFrame:
    """K, p, threshold, rows, degrees of freedom, roots and stability of every model."""
    def side(regime: str, column: str) -> Column:
        return F.max(F.when(F.col("regime") == regime, F.col(column)))

    per = checks.groupBy("model").agg(
        F.max("k").alias("k"), side("low", "n_obs").alias("low_obs"), side("high", "n_obs").alias("high_obs"),
        side("low", "rho").alias("_rl"), side("high", "rho").alias("_rh"),
    )
    n_x = F.col("k") * F.col("p") + 1
    return spec.select("model", "p", "delay", "theta", F.col("share_low").alias("theta_pct")).join(per, "model").select(
        "model", "k", "p", "delay", "theta", "theta_pct", "low_obs", "high_obs",
        (F.col("low_obs") - n_x).alias("df_low_per_eq"), (F.col("high_obs") - n_x).alias("df_high_per_eq"),
        F.bround("_rl", 3).alias("low_rho"), F.bround("_rh", 3).alias("high_rho"),
        (F.col("_rl") < 1).alias("low_stable"), (F.col("_rh") < 1).alias("high_stable"),
    )


# ------------------------------------------------- covariance and impact


def residual_covariance(fits: DataFrame, method: str = "stacked", floor: float = 1e-8,
                        stored: DataFrame | None = None) -> DataFrame:
    """One covariance per model: a stored one, else that of the stacked residuals, else the identity.

    Residuals of a fit with intercept have mean zero, so stacking regimes adds their
    cross-products.  ``weighted`` divides by the summed degrees of freedom instead.
    """
    n_cells = F.col("k") * F.col("k")
    cells = fits.select("model", "names", "k", "n_obs", F.posexplode("sigma").alias("_at", "_s"))
    weight = F.greatest(F.col("n_obs") - 1, F.lit(0))
    off = F.lit(1) if method == "stacked" else F.count("*")
    summed = cells.groupBy("model", "names", "k", "_at").agg(
        (F.sum(weight * F.col("_s")) / F.greatest(F.sum("n_obs") - off, F.lit(1))).alias("_v")
    )
    flat = summed.groupBy("model", "names", "k").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("_cov")
    )
    eye = F.transform(F.sequence(F.lit(0), n_cells - 1), lambda i: F.when(i % (F.col("k") + 1) == 0, 1.0).otherwise(0.0))
    usable = F.size("_cov") == n_cells
    if stored is not None:
        flat = flat.join(stored.select("model", F.col("sigma").alias("_stored")), "model", "left")
        chosen = F.coalesce("_stored", F.when(usable, F.col("_cov")), eye)
    else:
        chosen = F.coalesce(F.when(usable, F.col("_cov")), eye)

    @F.pandas_udf("array<double>")
    def floored(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([
            linalg.floor_eigenvalues(np.asarray(v, float).reshape(int(n), int(n)), floor).ravel() for v, n in zip(s, k)
        ])

    return flat.select("model", "names", "k", floored(chosen, F.col("k")).alias("sigma"))


def complete_ordering(ordering: Sequence[str] | None, variables: Sequence[str]) -> list[str]:
    """Known names of an ordering first, the other variables after them."""
    head = [v for v in ordering or () if v in variables]
    return head + [v for v in variables if v not in head]


def impact_matrices(covs: DataFrame, method: str = "cholesky", ordering: Sequence[str] | None = None,
                    shrink: float = 0.0, floor: float = 1e-8, signs: Sequence[tuple[str, str, str]] = (),
                    custom: Sequence[float] | None = None) -> DataFrame:
    """Impact matrix per covariance as a flat column ``a`` next to the keys.

    A sign constraint binds the models that have both of its variables.
    """
    if not 0 <= shrink < 1:
        raise ValueError("shrink must be in [0, 1)")
    if method == "custom" and custom is None:
        raise ValueError("method 'custom' needs a matrix")
    if method == "sign" and not signs:
        raise ValueError("method 'sign' needs sign constraints")
    wanted = {"+": 1, "-": -1, "0": 0}

    @F.pandas_udf("array<double>")
    def impact(sigma: pd.Series, names: pd.Series, k: pd.Series) -> pd.Series:
        out = []
        for s, nm, n in zip(sigma, names, k):
            nm, n = list(nm), int(n)
            order = [nm.index(v) for v in complete_ordering(ordering, nm)]
            sc = [(nm.index(r), nm.index(c), wanted[w]) for r, c, w in signs if r in nm and c in nm]
            a = linalg.impact_matrix(np.asarray(s, float).reshape(n, n), method, order, shrink, floor, sc,
                                     None if custom is None else np.asarray(custom, float))
            out.append(a.ravel())
        return pd.Series(out)

    return covs.withColumn("a", impact("sigma", "names", "k"))


def identification_issues(method: str, has_sigma: bool, ordering: Sequence[str] | None, variables: Sequence[str],
                          signs: Sequence[tuple[str, str, str]] = (), custom: Sequence[float] | None = None) -> list[str]:
    """Problems of an identification choice, before any job runs."""
    out = []
    if method not in ("unit", "cholesky", "sign", "custom"):
        out.append(f"unknown method {method!r}")
    if method in ("cholesky", "sign") and not has_sigma:
        out.append("no residual covariance")
    out += [f"ordering has unknown variable {v!r}" for v in ordering or () if v not in variables]
    if ordering and len(set(ordering)) != len(ordering):
        out.append("ordering repeats a variable")
    for r, c, w in signs:
        out += [f"sign constraint on unknown variable {v!r}" for v in (r, c) if v not in variables]
        if w not in ("+", "-", "0"):
            out.append(f"sign {w!r} is not one of + - 0")
    if method == "sign" and not signs:
        out.append("no sign constraints")
    if method == "custom":
        if custom is None:
            out.append("no custom matrix")
        elif len(custom) != len(variables) ** 2:
            out.append("custom matrix has the wrong size")
    return out
