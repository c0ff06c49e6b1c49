"""Research statistics: information coefficients, regressions per period, HAC errors, multiple testing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .crosssection import average_rank


def information_coefficient(df: DataFrame, day: str, score: str, forward: str, least: int) -> DataFrame:
    """Per day the rank and plain correlation of score and forward return; days with fewer than ``least`` pairs are left out."""
    x = df.where(F.col(score).isNotNull() & F.col(forward).isNotNull())
    x = x.select(day, score, forward, average_rank(score, [day]).alias("__a"), average_rank(forward, [day]).alias("__b"))
    g = x.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.corr("__a", "__b").alias("spearman"), F.corr(score, forward).alias("pearson"))
    return g.where(F.col("n") >= least)


def period_regressions(df: DataFrame, period: str, y: str, x: str, least: int) -> DataFrame:
    """One-variable least squares per period from built-in aggregates: slope, alpha, r2, t of the slope, n."""
    d = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    g = d.groupBy(period).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("alpha"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    se = F.sqrt(F.greatest(F.col("syy") * (1 - F.col("r2")) / F.nullif(F.col("n") - 2, F.lit(0)) / F.nullif(F.col("sxx"), F.lit(0.0)), F.lit(0.0)))
    return g.where(F.col("n") >= least).withColumn("t", F.try_divide(F.col("slope"), F.nullif(se, F.lit(0.0)))).drop("sxx", "syy")


def newey_west(df: DataFrame, order: str, value: str, lags: int) -> DataFrame:
    """One row: n, mean and the Newey-West standard error (Bartlett weights) of a series with one value per period.

    The series has one row per period, so its global window is as long as the calendar.
    """
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    a = Window.partitionBy(F.lit(0))
    e = df.select(order, F.col(value).alias("v")).withColumn("e", F.col("v") - F.avg("v").over(a))
    e = e.select("v", "e", *[F.lag("e", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    g = e.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    s = F.col("g0")
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.col(f"g{k}")
    return g.select("n", "mean", F.sqrt(F.greatest(s / F.col("n"), F.lit(0.0)) / F.col("n")).alias("se"))


def newey_west_by(df: DataFrame, group: str, order: str, value: str, lags: int) -> DataFrame:
    """:func:`newey_west` for every group: one row per group with n, mean, se. Lagged products are windows over a group's periods."""
    a, w = Window.partitionBy(group), Window.partitionBy(group).orderBy(order)
    e = df.where(F.col(value).isNotNull()).select(group, order, F.col(value).alias("v")).withColumn("e", F.col("v") - F.avg("v").over(a))
    e = e.select(group, "v", "e", *[F.lag("e", k).over(w).alias(f"l{k}") for k in range(1, lags + 1)])
    g = e.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.sum(F.col("e") * F.col("e")).alias("g0"), *[F.coalesce(F.sum(F.col("e") * F.col(f"l{k}")), F.lit(0.0)).alias(f"g{k}") for k in range(1, lags + 1)])
    s = sum((2 * (1 - k / (lags + 1)) * F.col(f"g{k}") for k in range(1, lags + 1)), F.col("g0"))
    return g.select(group, "n", "mean", F.sqrt(F.greatest(s / F.col("n"), F.lit(0.0)) / F.col("n")).alias("se"))


def normal_two_sided(t: float) -> float:
    return math.erfc(abs(t) / math.sqrt(2))


def multiple_testing(tests: DataFrame, name: str, t: str, alpha: float) -> DataFrame:
    """Per test the two-sided normal p, its rank, and whether Bonferroni and Benjamini-Hochberg keep it.

    ``tests`` has one row per hypothesis; its global window is as long as the list of hypotheses.
    """
    p = F.pandas_udf(lambda s: pd.Series(np.vectorize(normal_two_sided, otypes=[float])(s.to_numpy(float)) if len(s) else np.zeros(0)), "double")
    x = tests.where(F.col(t).isNotNull()).select(name, t, p(t).alias("p"))
    all_, by = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy("p", name)
    x = x.withColumn("rank", F.row_number().over(by)).withColumn("m", F.count(F.lit(1)).over(all_))
    last = F.max(F.when(F.col("p") <= alpha * F.col("rank") / F.col("m"), F.col("rank"))).over(all_)
    return x.select(name, "p", "rank", (F.col("p") <= alpha / F.col("m")).alias("bonferroni"), F.coalesce(F.col("rank") <= last, F.lit(False)).alias("benjamini_hochberg"))


def deflated_sharpe(observed: float, n_trials: int, n_observations: int, skewness: float = 0.0, kurtosis: float = 3.0, benchmark: float = 0.0, trial_spread: float = 1.0) -> float:
    """Probability that a Sharpe ratio beats ``benchmark`` and the best of ``n_trials`` chance ones.

    ``trial_spread`` is the standard deviation of the trials' ratios, 1 if they are standardised.
    For ratios per period it is about ``1 / sqrt(n_observations)``, as in the published form.
    """
    from statistics import NormalDist

    if n_trials < 1 or n_observations < 2:
        raise ValueError("at least one trial and two observations")
    z, g = NormalDist().inv_cdf, 0.5772156649
    best = 0.0 if n_trials < 2 else trial_spread * ((1 - g) * z(1 - 1 / n_trials) + g * z(1 - 1 / (n_trials * math.e)))
    spread = 1 - skewness * observed + (kurtosis - 1) / 4 * observed**2
    return NormalDist().cdf((observed - max(benchmark, best)) * math.sqrt((n_observations - 1) / spread)) if spread > 0 else 0.0


def implied_breadth(ic: Column, target_ratio: float) -> Column:
    """Independent bets that an information ratio needs at this coefficient."""
    return (target_ratio / F.nullif(ic, F.lit(0.0))) ** 2


def random_benchmark(df: DataFrame, day: str, forward: str, chance: Callable[[Column], Column], trials: int, least: int, target_ratio: float) -> DataFrame:
    """What signals of chance reach: per ``trial`` the months, mean rank correlation with ``forward``, its t and the implied breadth.

    ``chance`` makes the signal of a trial number from columns of ``df``; trials are rows, so all
    of them are ranked in one plan.
    """
    x = df.where(F.col(forward).isNotNull()).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))
    x = x.withColumn("__r", chance(F.col("trial")))
    x = x.select("trial", day, average_rank("__r", ["trial", day]).alias("a"), average_rank(forward, ["trial", day]).alias("b"))
    c = x.groupBy("trial", day).agg(F.corr("a", "b").alias("ic"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    g = c.groupBy("trial").agg(F.count(F.lit(1)).alias("n_months"), F.avg("ic").alias("mean_ic"), F.stddev_samp("ic").alias("sd"))
    return g.select("trial", "n_months", "mean_ic", (F.col("mean_ic") / F.nullif("sd", F.lit(0.0)) * F.sqrt("n_months")).alias("t"), implied_breadth(F.col("mean_ic"), target_ratio).alias("implied_breadth"))


def hysteresis(df: DataFrame, key: str, day: str, value: str, threshold: float) -> DataFrame:
    """``key``, ``day``, ``adopted``: a value is adopted only if it moved more than ``threshold`` from the one adopted last.

    What is adopted depends on all that was before, so a key's values are folded in order: numpy
    over Arrow batches of whole keys, which arrive spread by key and sorted. A key has one value
    per day, so its fold is bounded by the calendar. Null values are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    x = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.to_date(day).alias("d"), F.col(value).cast("double").alias("v"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0.0
        for b in batches:
            out = []
            for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist(), strict=True):
                if k != last or abs(v - held) > threshold:
                    last, held = k, v
                out.append(held)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("d"), pa.array(out, pa.float64())], names=["k", "d", "adopted"])

    y = x.repartition("k").sortWithinPartitions("k", "d").mapInArrow(fold, f"k {kind}, d date, adopted double")
    return y.select(F.col("k").alias(key), F.col("d").alias(day), "adopted")
