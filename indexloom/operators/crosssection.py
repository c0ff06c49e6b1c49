"""Cross-sectional statistics within a group (usually a day): every operator is windows over the group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winsorise(df: DataFrame, group: Sequence[str], value: str, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """``df`` with ``winsorised``: clipped to the group's interpolated quantiles, which come from one aggregation joined back."""
    q = df.groupBy(*group).agg(F.percentile(value, F.array(F.lit(lower), F.lit(upper))).alias("__q"))
    return df.join(q, list(group)).withColumn("winsorised", F.least(F.greatest(F.col(value), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def winsorise_mad(df: DataFrame, group: Sequence[str], value: str, sigmas: float = 3.0) -> DataFrame:
    """As :func:`winsorise` with bounds at the median plus and minus ``sigmas`` robust deviations."""
    m = df.groupBy(*group).agg(F.median(value).alias("__m"))
    x = df.join(m, list(group))
    s = x.groupBy(*group).agg((1.4826 * sigmas * F.median(F.abs(F.col(value) - F.col("__m")))).alias("__s"))
    y = x.join(s, list(group))
    return y.withColumn("winsorised", F.least(F.greatest(F.col(value), F.col("__m") - F.col("__s")), F.col("__m") + F.col("__s"))).drop("__m", "__s")


def zscore(value: str, group: Sequence[str], weight: str | None = None) -> Column:
    """(x - mean or weighted mean) / sample deviation within the group; 0 for fewer than two values or none that differ."""
    w = Window.partitionBy(*group)
    mean = F.avg(value).over(w) if weight is None else F.sum(F.col(value) * F.col(weight)).over(w) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).over(w), F.lit(0.0))
    sd = F.stddev_samp(value).over(w)
    return F.when(sd.isNull() | (sd <= 1e-12), F.when(F.col(value).isNotNull(), 0.0)).otherwise((F.col(value) - mean) / sd)


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Rank from 1 with ties sharing their mean; null for null."""
    w = Window.partitionBy(*group)
    first = F.rank().over(w.orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), first + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2.0)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, in Arrow batches; null outside (0, 1)."""

    def ppf(x: pa.Array) -> pa.Array:
        inv = NormalDist().inv_cdf
        return pa.array([inv(v) if v is not None and 0 < v < 1 else None for v in x.to_pylist()], pa.float64())

    return F.arrow_udf(ppf, "double")(p)


def rank_normalise(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """``df`` with ``normal``: the normal quantile of average rank / (n + 1)."""
    p = average_rank(value, group) / (F.count(value).over(Window.partitionBy(*group)) + 1)
    return df.withColumn("__p", p).withColumn("normal", normal_quantile(F.col("__p"))).drop("__p")


def neutralise(df: DataFrame, group: Sequence[str], category: str, value: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``neutral``: the residual on category dummies, which is the distance from the category's (weighted) mean."""
    w = Window.partitionBy(*group, category)
    mean = F.avg(value).over(w) if weight is None else F.sum(F.col(value) * F.col(weight)).over(w) / F.nullif(F.sum(F.when(F.col(value).isNotNull(), F.col(weight))).over(w), F.lit(0.0))
    return df.withColumn("neutral", F.col(value) - mean)


def fill(df: DataFrame, group: Sequence[str], value: str, policy: str, category: str | None = None) -> DataFrame:
    """``df`` with ``filled``: nulls as 0 (``neutral``), the 5th percentile (``penalise``) or the category median (``category``), or left out (``exclude``)."""
    if policy == "exclude":
        return df.where(F.col(value).isNotNull()).withColumn("filled", F.col(value))
    if policy == "neutral":
        return df.withColumn("filled", F.coalesce(F.col(value), F.lit(0.0)))
    keys = [*group, *([category] if policy == "category" else [])]
    s = df.groupBy(*keys).agg((F.median(value) if policy == "category" else F.percentile(value, F.lit(0.05))).alias("__f"))
    return df.join(s, keys).withColumn("filled", F.coalesce(F.col(value), F.col("__f"))).drop("__f")


def combine(scores: Mapping[str, float], method: str, group: Sequence[str]) -> Column:
    """``integrated``: the weighted mean with nulls as 0; ``mixed``: the mean of percentile ranks."""
    total = sum(scores.values())
    if method == "integrated":
        return sum((F.coalesce(F.col(c), F.lit(0.0)) * (w / total) for c, w in scores.items()), F.lit(0.0))
    ranks = [average_rank(c, group) / F.count(c).over(Window.partitionBy(*group)) * (w / total) for c, w in scores.items()]
    return sum(ranks[1:], ranks[0])


def quantile_bin(value: str, group: Sequence[str], n: int, tie: str) -> Column:
    """Bin 1..n of the first-come rank with edges interpolated over the ranks, as a quantile cut does (unlike NTILE)."""
    w = Window.partitionBy(*group)
    r = F.row_number().over(w.orderBy(value, tie))
    c = F.count(F.lit(1)).over(w)
    return F.when(c > 1, F.greatest(F.lit(1), F.ceil((r - 1) * n / (c - 1)))).otherwise(1).cast("int")


def normalised_weight(raw: Column, group: Sequence[str]) -> Column:
    """Share of the group's total; null where the total is not positive."""
    w = Window.partitionBy(*group)
    s = F.sum(raw).over(w)
    return F.when(s > 0, raw / s)


def cap_weights(df: DataFrame, group: Sequence[str], weight: str, cap: float, tie: str) -> DataFrame:
    """``df`` with ``capped`` and ``feasible``: weights limited to ``cap``, the excess spread over the others in proportion.

    The fixed point in closed form: by falling weight the capped names are a prefix; its length is
    the least k at which the largest remaining name, rescaled, fits under the cap. Two windows, no
    iteration. Where cap * n < 1 nothing fits: ``feasible`` is false and weights are equal.
    """
    w = Window.partitionBy(*group)
    order = w.orderBy(F.desc(weight), tie)
    x = df.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__t", F.sum(weight).over(w))
    x = x.withColumn("__w", F.col(weight) / F.col("__t"))
    x = x.withColumn("__before", F.coalesce(F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    free = F.nullif(1 - F.col("__before"), F.lit(0.0))
    fits = F.col("__w") * (1 - F.col("__i") * cap) <= cap * free * (1 + 1e-12)
    x = x.withColumn("__k", F.min(F.when(fits, F.col("__i"))).over(w))
    x = x.withColumn("__s", F.max(F.when(F.col("__i") == F.col("__k"), F.col("__before"))).over(w))
    scaled = F.when(F.col("__i") < F.col("__k"), F.lit(cap)).otherwise(F.col("__w") * (1 - F.col("__k") * cap) / F.nullif(1 - F.col("__s"), F.lit(0.0)))
    ok = F.col("__n") * cap >= 1 - 1e-12
    return x.withColumn("feasible", ok).withColumn("capped", F.when(ok, scaled).otherwise(1 / F.col("__n"))).drop("__i", "__n", "__t", "__w", "__before", "__k", "__s")


def prefix_sums(df: DataFrame, group: Sequence[str], size: str, tie: str, steps: int = 64) -> DataFrame:
    """``df`` with exact DECIMAL ``running`` and ``total`` sums of ``size`` within the group, by falling size, then ``tie``.

    Two levels: rows fall into ranges of size (``steps`` per doubling), whose sums are one row per
    range; only the rows of one range are ordered in one task. So a group is never sorted whole,
    and DECIMAL sums do not depend on order or partitioning. Sizes must be positive.
    """
    d = F.col(size).cast("decimal(28,4)")
    x = df.withColumn("__d", d).withColumn("__b", -F.floor(F.log2(size) * steps).cast("long"))
    sums = x.groupBy(*group, "__b").agg(F.sum("__d").alias("__s"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__s").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("decimal(38,4)"))
    sums = sums.select(*group, "__b", before.alias("__before"), F.sum("__s").over(w).alias("total"))
    own = F.sum("__d").over(Window.partitionBy(*group, "__b").orderBy(F.desc(size), tie).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return x.join(sums, [*group, "__b"]).withColumn("running", own + F.col("__before")).drop("__d", "__b", "__before")


def cumulative_bands(df: DataFrame, group: Sequence[str], size: str, tie: str, cuts: Mapping[str, float], rest: str) -> DataFrame:
    """``df`` with ``cumulative`` share by falling size and the ``band`` of the first cut that holds it.

    Exact sums, rounded to 12 places before comparing: neither order nor partitioning can move a
    name over a cut. Rows whose size is null or not positive have no share and the band ``rest``.
    """
    big = prefix_sums(df.where(F.col(size) > 0), group, size, tie)
    x = big.withColumn("cumulative", F.round(F.col("running").cast("double") / F.col("total").cast("double"), 12)).drop("running", "total")
    band = None
    for name, cut in cuts.items():
        band = F.when(F.col("cumulative") <= cut, name) if band is None else band.when(F.col("cumulative") <= cut, name)
    none = df.where(~F.coalesce(F.col(size) > 0, F.lit(False))).withColumn("cumulative", F.lit(None).cast("double"))
    return x.unionByName(none).withColumn("band", band.otherwise(rest))


def buffered_bands(df: DataFrame, group: Sequence[str], size: str, tie: str, cuts: Mapping[str, float], rest: str, previous: str, width: float) -> DataFrame:
    """:func:`cumulative_bands` with a buffer for incumbents: ``hard`` is the band by the cuts, ``band`` the one given, with ``held`` and ``moved``.

    A name whose ``previous`` band is next to its hard one keeps it while its cumulative share is
    within ``width`` of the cut between the two, the border included. Without a previous band
    nothing is held or moved.
    """
    names = [*cuts, rest]
    x = cumulative_bands(df, group, size, tie, cuts, rest).withColumnRenamed("band", "hard")
    held = F.lit(False)
    for (cut, a), b in zip(zip(cuts.values(), names, strict=False), names[1:], strict=False):
        pair = ((F.col(previous) == a) & (F.col("hard") == b)) | ((F.col(previous) == b) & (F.col("hard") == a))
        held = held | (pair & (F.round(F.abs(F.col("cumulative") - cut), 12) <= width))
    held = F.coalesce(held, F.lit(False))
    x = x.withColumn("held", held).withColumn("band", F.when(F.col("held"), F.col(previous)).otherwise(F.col("hard")))
    return x.withColumn("moved", F.coalesce(F.col("band") != F.col(previous), F.lit(False)))


def band_summary(bands: DataFrame, group: Sequence[str], size: str) -> DataFrame:
    """Per band: names, ``size``, its ``weight`` in the group, and how many moved or were held."""
    g = bands.groupBy(*group, "band").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size"), F.count_if("moved").alias("moved"), F.count_if("held").alias("held"))
    return g.withColumn("weight", F.try_divide("size", F.nullif(F.sum("size").over(Window.partitionBy(*group)), F.lit(0.0))))


def liquidity(rows: DataFrame, name: str, day: str, close: str, volume: str, paused: str, sessions: int) -> DataFrame:
    """Per name over the market's last ``sessions`` sessions: ``traded`` (median traded value), ``n``, ``last_close``, ``paused``, ``vol`` (yearly, of log returns) and ``percentile`` of traded.

    Sessions are the distinct days of the table, not calendar days. The percentile is the rank by
    (traded, name) from 0 over n - 1.
    """
    last = rows.select(day).distinct().withColumn("r", F.row_number().over(Window.orderBy(F.desc(day)))).where(F.col("r") <= sessions).agg(F.min(day)).scalar()  # one row per day of the calendar
    x = rows.where(F.col(day) >= last)
    w = Window.partitionBy(name).orderBy(day)
    x = x.withColumn("move", F.log(F.col(close) / F.lag(close).over(w)))
    g = x.groupBy(name).agg(
        F.median(F.col(close) * F.col(volume)).alias("traded"), F.count(F.lit(1)).alias("n"), F.max_by(close, day).alias("last_close"), F.coalesce(F.max_by(paused, day), F.lit(False)).alias("paused"), (F.stddev_samp("move") * 252**0.5).alias("vol")
    )
    all_ = Window.partitionBy(F.lit(0))
    order = all_.orderBy(F.col("traded").asc_nulls_first(), name)  # one row per name
    return g.withColumn("percentile", F.try_divide(F.row_number().over(order) - 1, F.nullif(F.count(F.lit(1)).over(all_) - 1, F.lit(0))))


def pipeline(df: DataFrame, group: Sequence[str], category: str, value: str, weight: str) -> DataFrame:
    """``df`` with ``score``: winsorised, standardised, neutralised to its category, standardised again, with the category's median for a missing value.

    Every step is a window or a joined aggregate of the group, so a whole panel of days is one plan.
    """
    x = winsorise(df, group, value).withColumn("__z", zscore("winsorised", group, weight))
    x = neutralise(x, group, category, "__z", weight).withColumn("__s", zscore("neutral", group))
    return fill(x, group, "__s", "category", category).withColumnRenamed("filled", "score").drop("winsorised", "neutral", "__z", "__s")


def ceiling_weights(df: DataFrame, group: Sequence[str], weight: str, ceiling: str, tie: str) -> DataFrame:
    """``df`` with ``limited`` and ``feasible``: weights scaled up in proportion until they meet their own ceilings.

    The fixed point of "freeze what exceeds its ceiling, spread the rest" in closed form: every name
    gets min(ceiling, s * weight), and names freeze in the order of ceiling / weight, so the frozen
    ones are a prefix. Infeasible groups (ceilings below 1 in sum) give every name its ceiling.
    """
    w = Window.partitionBy(*group)
    x = df.withColumn("__w", F.col(weight) / F.sum(weight).over(w)).withColumn("__r", F.try_divide(F.col(ceiling), F.nullif(F.col("__w"), F.lit(0.0))))
    order = w.orderBy(F.col("__r").asc_nulls_last(), tie)
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("__c", F.coalesce(F.sum(ceiling).over(past), F.lit(0.0))).withColumn("__f", F.coalesce(F.sum("__w").over(past), F.lit(0.0)))
    scale = F.try_divide(1 - F.col("__c"), F.nullif(1 - F.col("__f"), F.lit(0.0)))
    x = x.withColumn("__s", F.when((scale <= F.col("__r") * (1 + 1e-12)) | F.col("__r").isNull(), scale)).withColumn("__i", F.row_number().over(order))
    first = F.min(F.when(F.col("__s").isNotNull(), F.struct("__i", "__s"))).over(w)
    ok = F.sum(ceiling).over(w) >= 1 - 1e-12
    limited = F.when(ok & first.isNotNull(), F.least(F.col(ceiling), first["__s"] * F.col("__w"))).otherwise(F.col(ceiling))
    return x.withColumn("feasible", ok).withColumn("limited", limited).drop("__w", "__r", "__c", "__f", "__s", "__i")


def cap_groups(df: DataFrame, by: Sequence[str], category: str, weight: str, cap: float) -> DataFrame:
    """``df`` with ``group_capped``: no category above ``cap`` within ``by``, names keeping their proportions inside it.

    The single-name cap applied to category totals, one row per category.
    """
    totals = df.groupBy(*by, category).agg(F.sum(weight).alias("__g"))
    capped = cap_weights(totals, by, "__g", cap, category).select(*by, category, "__g", F.col("capped").alias("__c"), "feasible")
    return df.join(capped, [*by, category]).withColumn("group_capped", F.try_divide(F.col(weight) * F.col("__c"), F.nullif(F.col("__g"), F.lit(0.0)))).drop("__g", "__c")


def top_fraction(df: DataFrame, group: Sequence[str], score: str, tie: str, fraction: float) -> DataFrame:
    """The best ``fraction`` of each group by score: max(1, n times fraction rounded half to even) rows."""
    w = Window.partitionBy(*group)
    k = F.greatest(F.lit(1.0), F.bround(F.count(F.lit(1)).over(w) * F.lit(fraction), 0))
    return df.withColumn("__k", k).withColumn("__i", F.row_number().over(w.orderBy(F.desc(score), tie))).where(F.col("__i") <= F.col("__k")).drop("__k", "__i")
