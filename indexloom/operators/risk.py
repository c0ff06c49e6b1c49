"""Second moments, shrinkage, principal components and risk of panels of asset vectors.

A panel has one row per period and a vector with one entry per asset. Its Gram matrix is summed in
partial matrices per task (numpy over Arrow batches) and then by (i, j), so nothing is joined with
itself. What comes to the driver is assets x assets, bounded by ``MAX_ASSETS``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ASSETS = 4096


def _matrix(v: pa.Array, width: int) -> np.ndarray:
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != width * len(v):
        raise ValueError("vectors of different length")
    return flat.reshape(len(v), width)


#: Assets of a block of a panel that is wider than MAX_ASSETS.
BLOCK = 1024


def gram(panel: DataFrame, vector: str, weight: Column | None = None, widest: int = MAX_ASSETS) -> DataFrame:
    """(i, j, n, w, w2, wi, wj, wij) for i <= j: weighted sums over periods. Rows with a null vector do not count.

    Up to ``widest`` assets a task keeps one partial matrix. Beyond, no matrix is held: every batch
    gives its sums block by block, which moves more rows and needs memory for one block only.
    """
    w = weight if weight is not None else F.lit(1.0)
    x = panel.where(F.col(vector).isNotNull()).select(w.cast("double").alias("w"), F.col(vector).cast("array<double>").alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, sw, sw2 = None, 0, 0.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("w").to_numpy().astype(float)
            m = _matrix(b.column("v"), len(b.column("v")[0]))
            if m.shape[1] > widest:
                yield from _blocks(m, own, min(BLOCK, widest))
                continue
            e = np.c_[np.ones(len(m)), m]
            g = e.T @ (e * own[:, None])
            total = g if total is None else total + g
            n, sw, sw2 = n + len(m), sw + own.sum(), sw2 + (own**2).sum()
        if total is not None:
            i, j = np.triu_indices(total.shape[0] - 1)
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(np.full(len(i), n), pa.int64()), "w": np.full(len(i), sw), "w2": np.full(len(i), sw2), "wi": total[0, 1 + i], "wj": total[0, 1 + j], "wij": total[1 + i, 1 + j]}
            )

    parts = x.mapInArrow(partial, "i int, j int, n bigint, w double, w2 double, wi double, wj double, wij double")
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "w", "w2", "wi", "wj", "wij")])


def _blocks(m: np.ndarray, own: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The sums of one batch, a batch of rows per pair of blocks of assets."""
    n, sums = len(m), own @ m
    for a in range(0, m.shape[1], size):
        left = m[:, a : a + size] * own[:, None]
        for b in range(a, m.shape[1], size):
            g = left.T @ m[:, b : b + size]
            i, j = (np.triu_indices(len(g)) if a == b else tuple(x.ravel() for x in np.indices(g.shape)))
            k = len(i)
            yield pa.RecordBatch.from_pydict(
                {"i": pa.array(a + i, pa.int32()), "j": pa.array(b + j, pa.int32()), "n": pa.array(np.full(k, n), pa.int64()), "w": np.full(k, own.sum()), "w2": np.full(k, (own**2).sum()), "wi": sums[a + i], "wj": sums[b + j], "wij": g[i, j]}
            )


def covariances(panel: DataFrame, vector: str) -> DataFrame:
    """Sample covariance (n - 1) and correlation of every pair i <= j; null for fewer than two periods."""
    g = gram(panel, vector).withColumn("cov", F.try_divide(F.col("wij") - F.col("wi") * F.col("wj") / F.col("n"), F.nullif(F.col("n") - 1, F.lit(0))))
    d = g.where("i = j").select(F.col("i").alias("a"), F.col("cov").alias("v"))
    x = g.join(d.select(F.col("a").alias("i"), F.col("v").alias("vi")), "i").join(d.select(F.col("a").alias("j"), F.col("v").alias("vj")), "j")
    return x.select("i", "j", "n", "cov", F.try_divide(F.col("cov"), F.nullif(F.sqrt(F.col("vi") * F.col("vj")), F.lit(0.0))).alias("corr"))


def decayed_covariances(panel: DataFrame, vector: str, order: str, half_life: float) -> DataFrame:
    """Covariance with weights halving every ``half_life`` periods before the last, corrected for the weights' concentration.

    ``order`` is an integer period number; its maximum is a scalar subquery.
    """
    last = panel.agg(F.max(order)).scalar()
    g = gram(panel, vector, F.pow(F.lit(0.5), (last - F.col(order)) / half_life))
    mean = F.col("wij") / F.col("w") - F.col("wi") * F.col("wj") / (F.col("w") * F.col("w"))
    return g.select("i", "j", F.try_divide(mean, F.nullif(1 - F.col("w2") / (F.col("w") * F.col("w")), F.lit(0.0))).alias("cov"))


def matrix_of(cov: DataFrame, value: str = "cov") -> np.ndarray:
    """The full symmetric matrix on the driver; assets x assets, at most MAX_ASSETS squared."""
    rows = cov.where(F.col("j") <= MAX_ASSETS).select("i", "j", value).toArrow()
    if rows.num_rows and max(rows["j"].to_numpy()) == MAX_ASSETS:
        raise ValueError(f"a matrix of more than {MAX_ASSETS} assets stays in its rows")
    i, j, v = (rows[c].to_numpy() for c in ("i", "j", value))
    m = np.zeros((int(j.max()) + 1,) * 2) if len(i) else np.zeros((0, 0))
    m[i, j] = v
    m[j, i] = v
    return m


@dataclass(frozen=True)
class Shrunk:
    covariance: np.ndarray
    intensity: float


def shrink_to_constant_correlation(panel: DataFrame, vector: str) -> Shrunk:
    """Ledoit-Wolf shrinkage of the 1/T covariance to constant correlation, in two passes over the panel.

    The second pass sums the products of squared deviations that the intensity needs, again as
    partial matrices per task.
    """
    g = gram(panel, vector)
    rows = g.toArrow()
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    t = int(rows["n"][0].as_py())
    n = int(j.max()) + 1
    mean = np.zeros(n)
    diag = i == j
    mean[i[diag]] = rows["wi"].to_numpy()[diag] / t
    s = np.zeros((n, n))
    s[i, j] = rows["wij"].to_numpy() / t
    s[j, i] = s[i, j]
    s -= np.outer(mean, mean)
    x = panel.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, th = np.zeros((n, n)), np.zeros((n, n))
        for b in batches:
            if b.num_rows:
                y = _matrix(b.column("v"), n) - mean
                y2 = y**2
                pi += y2.T @ y2
                th += (y**3).T @ y
        a, c = np.divmod(np.arange(n * n), n)
        yield pa.RecordBatch.from_pydict({"i": pa.array(a, pa.int32()), "j": pa.array(c, pa.int32()), "pi": pi.ravel(), "th": th.ravel()})

    m = x.mapInArrow(partial, "i int, j int, pi double, th double").groupBy("i", "j").agg(F.sum("pi").alias("pi"), F.sum("th").alias("th")).toArrow()
    a, c = m["i"].to_numpy(), m["j"].to_numpy()
    pi, th = np.zeros((n, n)), np.zeros((n, n))
    pi[a, c], th[a, c] = m["pi"].to_numpy(), m["th"].to_numpy()
    sd = np.sqrt(np.diag(s))
    r = s / np.outer(sd, sd)
    rbar = (r.sum() - n) / (n * (n - 1)) if n > 1 else 0.0
    target = rbar * np.outer(sd, sd)
    np.fill_diagonal(target, sd**2)
    pi_mat = pi / t - s**2
    theta = th / t - np.diag(s)[:, None] * s
    off = ~np.eye(n, dtype=bool)
    rho = np.trace(pi_mat) + rbar * (np.outer(1 / sd, sd) * theta)[off].sum()
    gamma = ((target - s) ** 2).sum()
    k = 0.0 if gamma <= 0 else (pi_mat.sum() - rho) / gamma
    d = float(min(1.0, max(0.0, k / t)))
    return Shrunk(d * target + (1 - d) * s, d)


def principal_covariance(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(covariance from the largest components plus the specific diagonal, their eigenvalues falling)."""
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:components]
    low = vectors[:, order] * values[order] @ vectors[:, order].T
    return low + np.diag(np.maximum(np.diag(cov) - np.diag(low), 0)), values[order]


def positive_definite(m: np.ndarray, epsilon: float = 1e-10) -> np.ndarray:
    """The matrix with eigenvalues raised to at least ``epsilon``."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return vectors * np.maximum(values, epsilon) @ vectors.T


def minimum_variance(cov: np.ndarray, longest: float = 0.1) -> np.ndarray:
    """Weights proportional to the inverse covariance times one, clipped to [0, longest] and renormalised."""
    w = np.linalg.pinv(cov) @ np.ones(len(cov))
    w = np.clip(w / w.sum(), 0, longest)
    return w / w.sum()


def portfolio_variance(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """One row: w'Cw from weights (i, weight) and pairs i <= j, as joins and a sum."""
    a, b = weights.select("i", F.col("weight").alias("wi")), weights.select(F.col("i").alias("j"), F.col("weight").alias("wj"))
    x = cov.join(a, "i").join(b, "j")
    return x.agg(F.sum(F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0) * F.col("wi") * F.col("wj") * F.col("cov")).alias("variance"))


def marginal_contributions(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame, name: str, periods: float) -> DataFrame:
    """Per name ``marginal``, the change of yearly volatility per unit of weight, and ``contribution``, its weight times that.

    (C w)_i of a factor model is x_i' F (X'w) + specific_i w_i: the book's factor exposures are
    a few numbers, and the names x names matrix is never built. Contributions add up to the
    volatility. Inputs as in ``regression.risk_decomposition``.
    """
    book = weights.join(exposures, name).groupBy("factor").agg(F.sum(F.col("w") * F.col("exposure")).alias("x"))
    fx = factor_cov.join(book.select(F.col("factor").alias("b"), "x"), "b").groupBy("a").agg(F.sum(F.col("cov") * F.col("x")).alias("fx"))
    of_factors = exposures.join(fx.withColumnRenamed("a", "factor"), "factor").groupBy(name).agg(F.sum(F.col("exposure") * F.col("fx")).alias("c"))
    c = weights.join(of_factors, name).join(specific.select(name, "specific"), name, "left").withColumn("c", F.col("c") + F.coalesce("specific", F.lit(0.0)) * F.col("w"))
    sd = F.sqrt(F.greatest(c.agg(F.sum(F.col("w") * F.col("c"))).scalar(), F.lit(0.0)))
    m = F.try_divide(F.col("c"), F.nullif(sd, F.lit(0.0))) * periods**0.5
    return c.select(name, m.alias("marginal"), (F.col("w") * m).alias("contribution"))


def walk_forward(panel: DataFrame, order: str, vector: str, estimation: int, holding: int) -> DataFrame:
    """Minimum variance portfolios by estimator, each fitted on ``estimation`` periods and held for the next ``holding``: n_windows, mean ``forecast`` and ``realised`` volatility.

    Periods are numbered in order. A window starts every ``holding`` periods, so a period is in
    ``estimation / holding + 1`` of them and goes to each; windows are fitted in parallel, one task
    holding the periods of one window.
    """
    x = panel.where(F.col(vector).isNotNull()).select(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v"))
    x = x.withColumn("i", F.row_number().over(Window.orderBy("o")) - 1)  # one row per period
    n = x.agg(F.count(F.lit(1))).scalar()
    first = F.greatest(F.ceil((F.col("i") - (estimation + holding - 1)) / holding), F.lit(0))
    last = F.least(F.floor(F.col("i") / holding), F.floor((n - estimation - holding) / holding))
    x = x.withColumn("w", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("at", F.col("i") - F.col("w") * holding)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = np.array(pdf.sort_values("at")["v"].tolist())
        past, later = r[:estimation], r[estimation:]
        s = np.cov(past.T, ddof=1)
        kinds = {"sample": s, "components": principal_covariance(s, max(1, min(5, len(s) - 1)))[0], "diagonal": np.diag(np.diag(s))}
        out = []
        for k, c in kinds.items():
            w = minimum_variance(positive_definite(c), 1.0)
            out.append((k, float(np.sqrt(w @ c @ w)), float(np.std(later @ w, ddof=1))))
        return pd.DataFrame(out, columns=["estimator", "forecast", "realised"])

    y = x.groupBy("w").applyInPandas(fit, "estimator string, forecast double, realised double")
    return y.groupBy("estimator").agg(F.count(F.lit(1)).alias("n_windows"), F.avg("forecast").alias("forecast"), F.avg("realised").alias("realised"))
