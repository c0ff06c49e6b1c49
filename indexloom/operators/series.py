"""Time series per key: returns, volatility, drawdown, trailing and calendar performance, split adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRADING_DAYS = 252


def _by(key: str, day: str):
    return Window.partitionBy(key).orderBy(day)


def with_returns(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """``df`` with ``ret``, the change from the previous observation; null on the first and on a zero base."""
    return df.withColumn("ret", F.try_divide(F.col(value), F.nullif(F.lag(value).over(_by(key, day)), F.lit(0.0))) - 1)


def summary(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Per key: days, annualised return and volatility, Sortino ratio, drawdown, best and worst day, share of positive days.

    Returns and the running maximum share one window; everything else is one aggregation.
    """
    w = _by(key, day)
    x = with_returns(df, key, day, value).withColumn("dd", F.col(value) / F.max(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    first, last = F.min(F.struct(day, value)), F.max(F.struct(day, value))
    g = x.groupBy(key).agg(
        F.count("ret").alias("n"), first.alias("a"), last.alias("b"), F.stddev_samp("ret").alias("sd"), F.stddev_samp(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.avg("ret").alias("mean"),
        F.min("dd").alias("max_drawdown"), F.max("ret").alias("best"), F.min("ret").alias("worst"), F.avg((F.col("ret") > 0).cast("double")).alias("positive_share"),
    )
    years = F.datediff(F.col(f"b.{day}"), F.col(f"a.{day}")) / 365.25
    ann = F.pow(F.col(f"b.{value}") / F.col(f"a.{value}"), F.try_divide(F.lit(1.0), F.nullif(years, F.lit(0.0)))) - 1
    return g.select(
        key, "n", ann.alias("annual_return"), (F.col("sd") * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annual_vol"),
        F.try_divide(F.col("mean") * TRADING_DAYS, F.nullif(F.col("down") * F.sqrt(F.lit(float(TRADING_DAYS))), F.lit(0.0))).alias("sortino"), "max_drawdown", "best", "worst", "positive_share",
    )


def trailing_performance(df: DataFrame, key: str, day: str, value: str, periods: Sequence[int]) -> DataFrame:
    """Per key the return over the last n observations for each n, null where there are fewer."""
    w = _by(key, day)
    x = df.select(key, day, value, *[(F.try_divide(F.col(value), F.nullif(F.lag(value, n).over(w), F.lit(0.0))) - 1).alias(f"r{n}") for n in periods])
    return x.groupBy(key).agg(F.max(F.struct(day, *[f"r{n}" for n in periods])).alias("s")).select(key, *[F.col(f"s.r{n}").alias(f"return_{n}") for n in periods])


def calendar_years(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Return of each calendar year from one year-end's last value to the next."""
    g = df.groupBy(key, F.year(day).alias("year")).agg(F.max(F.struct(day, value)).alias("s")).select(key, "year", F.col(f"s.{value}").alias("last"))
    w = Window.partitionBy(key).orderBy("year")
    return g.select(key, "year", "last", (F.try_divide(F.col("last"), F.nullif(F.lag("last").over(w), F.lit(0.0))) - 1).alias("year_return"))


def period_ends(df: DataFrame, key: str, day: str) -> DataFrame:
    """Marks the last observation of each month and the first and last of all: (key, day, is_month_end, is_edge)."""
    w = _by(key, day)
    nxt = F.lead(day).over(w)
    return df.select(key, day, F.coalesce(F.trunc(day, "month") != F.trunc(nxt, "month"), F.lit(True)).alias("is_month_end"), (nxt.isNull() | F.lag(day).over(w).isNull()).alias("is_edge"))


def forward_compound(df: DataFrame, key: str, day: str, ret: str, horizon: int) -> DataFrame:
    """``df`` with ``forward``: the compounded return of the next ``horizon`` rows, null without all of them."""
    w = _by(key, day).rowsBetween(1, horizon)
    return df.withColumn("forward", F.when(F.count(ret).over(w) == horizon, F.exp(F.sum(F.log1p(ret)).over(w)) - 1))


def window_factors(df: DataFrame, key: str, day: str, ret: str, long: int, skip: int, short: int, least: int) -> DataFrame:
    """Latest momentum over the rows from ``long`` to ``skip`` ago, reversal of the last ``short``, volatility, downside volatility per key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(day)))
    x = df.where(F.col(ret).isNotNull()).withColumn("__n", n)
    lg = F.log1p(ret)
    g = x.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when((F.col("__n") > skip) & (F.col("__n") <= long), lg)).alias("m"), F.count_if((F.col("__n") > skip) & (F.col("__n") <= long)).alias("nm"),
        F.sum(F.when(F.col("__n") <= short, lg)).alias("s"), F.stddev_samp(F.when(F.col("__n") <= long, F.col(ret))).alias("v"), F.stddev_samp(F.when((F.col("__n") <= long) & (F.col(ret) < 0), F.col(ret))).alias("dv"),
    )
    root = F.sqrt(F.lit(float(TRADING_DAYS)))
    return g.select(
        key, "n", F.when(F.col("nm") == long - skip, F.exp("m") - 1).alias("momentum"), (1 - F.exp("s")).alias("reversal"), F.when(F.col("n") >= least, F.col("v") * root).alias("volatility"), F.when(F.col("n") >= least, F.col("dv") * root).alias("downside")
    )


def market_beta(df: DataFrame, key: str, day: str, ret: str, least: int) -> DataFrame:
    """Beta of each key to the equal-weighted mean return of its days."""
    m = df.where(F.col(ret).isNotNull()).groupBy(day).agg(F.avg(ret).alias("__m"))
    g = df.where(F.col(ret).isNotNull()).join(m, day).groupBy(key).agg(F.covar_samp(ret, "__m").alias("c"), F.var_samp("__m").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).select(key, "n", F.try_divide(F.col("c"), F.nullif(F.col("v"), F.lit(0.0))).alias("beta"))


def cumulative_factor(events: DataFrame, key: str, day: str, ratio: str) -> DataFrame:
    """Per event the product of all later ratios of its key: what a value before the event is divided by to be comparable with today's."""
    w = _by(key, day).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return events.withColumn("factor", F.exp(F.sum(F.log(ratio)).over(w)))


def chain(df: DataFrame, key: str, day: str, ratio: str, base: float) -> DataFrame:
    """``df`` with ``level``: ``base`` times the running product of the ratios (nulls count as 1)."""
    w = _by(key, day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("level", base * F.exp(F.sum(F.log(F.coalesce(F.col(ratio), F.lit(1.0)))).over(w)))


def resets(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """``df`` with ``is_reset`` (first row of a month) and ``struck``, the value at the month's first row."""
    w = _by(key, day)
    m = Window.partitionBy(key, F.trunc(day, "month")).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("is_reset", F.coalesce(F.trunc(day, "month") != F.trunc(F.lag(day).over(w), "month"), F.lit(True))).withColumn("struck", F.first(value).over(m))


def forward_rate(spot: Column, base_rate: Column, quote_rate: Column, years: Column) -> Column:
    """Covered interest parity."""
    return spot * (1 + base_rate * years) / (1 + quote_rate * years)


def leg_mark(notional: Column, forward: Column, spot: Column) -> Column:
    """Value of a hedge leg struck at ``forward`` now that the rate is ``spot``."""
    return notional * (forward - spot)


def carry(base_rate: Column, quote_rate: Column, years: Column) -> Column:
    """What holding the base currency earns over the other."""
    return (base_rate - quote_rate) * years
