"""Point-in-time and relational patterns: latest known rows, spells, runs, snapshots, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The last whole row per key by ``order``; ties fall to the greatest remaining values.

    A map-side combinable maximum of a struct, so no key is sorted in one task. Nulls in ``order``
    sort lowest. Unlike a column-wise "last non-null" this never mixes columns of different rows.
    """
    keep = [c for c in (keep or df.columns) if c not in keys]
    fields = [*order, *[c for c in keep if c not in order]]
    g = df.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("__s"))
    return g.select(*keys, *[F.col(f"__s.{c}").alias(c) for c in keep])


def known_at(df: DataFrame, as_of: str, known: str) -> DataFrame:
    """Rows known on a day; the predicate reaches the Parquet scan."""
    return df.where(F.col(known) <= F.lit(as_of).cast("date"))


def pit_latest(fundamentals: DataFrame, as_of: str, items: Sequence[str], max_staleness_days: int = 550) -> DataFrame:
    """Latest filing per security and item among those filed by ``as_of`` whose period is not too old."""
    d = F.lit(as_of).cast("date")
    x = known_at(fundamentals, as_of, "filed_date").where(F.col("item").isin(*items) & (F.col("period_end") >= F.date_sub(d, max_staleness_days)) & F.col("value").isNotNull())
    return latest_by(x, ["security_id", "item"], ["period_end", "filed_date", "value"], ["period_end", "filed_date", "value"])


def naive_latest(fundamentals: DataFrame, as_of: str, items: Sequence[str]) -> DataFrame:
    """The wrong query, kept so that tests can show the look-ahead: no condition on the filing date."""
    x = fundamentals.where((F.col("period_end") <= F.lit(as_of).cast("date")) & F.col("item").isin(*items) & F.col("value").isNotNull())
    return latest_by(x, ["security_id", "item"], ["period_end", "filed_date", "value"], ["period_end", "filed_date", "value"])


def trailing_sum(fundamentals: DataFrame, as_of: str, item: str, periods: int = 4) -> DataFrame:
    """Point-in-time sum of the last ``periods`` periods; securities with fewer are left out."""
    x = known_at(fundamentals, as_of, "filed_date").where((F.col("item") == item) & F.col("value").isNotNull() & F.col("period_end").isNotNull())
    one = latest_by(x, ["security_id", "period_end"], ["filed_date", "value"], ["filed_date", "value"])
    w = Window.partitionBy("security_id").orderBy(F.desc("period_end"))
    last = one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= periods)
    g = last.groupBy("security_id").agg(F.sum("value").alias("ttm"), F.count(F.lit(1)).alias("n"), F.max("period_end").alias("last_period"), F.max("filed_date").alias("last_filed"))
    return g.where(F.col("n") == periods).drop("n")


def month_last(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Last observation per key and month: key, month, value."""
    g = df.groupBy(key, F.trunc(day, "month").alias("month")).agg(F.max(F.struct(day, value)).alias("s"))
    return g.select(key, "month", F.col(f"s.{value}").alias(value))


def lag_ratio(df: DataFrame, key: str, order: str, value: str, near: int, far: int) -> Column:
    """value ``near`` rows ago over value ``far`` rows ago, minus 1; null without both or on a zero base."""
    w = Window.partitionBy(key).orderBy(order)
    return F.try_divide(F.lag(value, near).over(w), F.nullif(F.lag(value, far).over(w), F.lit(0.0))) - 1


def in_force(df: DataFrame, as_of: str | Column, start: str, end: str) -> DataFrame:
    """Rows whose half-open interval holds the day; a null end is open."""
    d = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return df.where((F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) > d)))


def spells(daily: DataFrame, axis: str, entity: str, day: str) -> DataFrame:
    """Runs of consecutive axis days per (axis, entity): gaps and islands over the axis's own calendar.

    The calendar number of a day comes from its distinct days (one row per axis and day), so the
    rank is computed on the small table and joined back.
    """
    d = daily.select(axis, entity, day).dropna().distinct()
    cal = d.select(axis, day).distinct().withColumn("__i", F.row_number().over(Window.partitionBy(axis).orderBy(day)))
    n = d.join(cal, [axis, day]).withColumn("__g", F.col("__i") - F.row_number().over(Window.partitionBy(axis, entity).orderBy(day)))
    return n.groupBy(axis, entity, "__g").agg(F.min(day).alias("from_date"), F.max(day).alias("to_date"), F.count(F.lit(1)).alias("n_days")).drop("__g")


def runs(df: DataFrame, key: str, order: str, value: Column, least: int) -> DataFrame:
    """Runs of ``least`` or more equal values in a row: key, from_date, to_date, n."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.select(key, order, value.alias("__v")).withColumn("__c", F.coalesce((F.col("__v") != F.lag("__v").over(w)).cast("int"), F.lit(1)))
    x = x.withColumn("__r", F.sum("__c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = x.groupBy(key, "__r").agg(F.min(order).alias("from_date"), F.max(order).alias("to_date"), F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") >= least).drop("__r")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str | Sequence[str], weight: str) -> DataFrame:
    """Full outer join of two weight snapshots: key columns, w0, w1, change."""
    keys = [key] if isinstance(key, str) else list(key)
    a = before.select(*keys, F.col(weight).alias("w0"))
    b = after.select(*keys, F.col(weight).alias("w1"))
    return a.join(b, keys, "full").withColumn("change", F.coalesce("w1", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))


def turnover(diff: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """One row per group, or one: one-way turnover, weight added and deleted, counts."""
    add, gone = F.col("w0").isNull(), F.col("w1").isNull()
    return diff.groupBy(*group).agg(
        (F.sum(F.abs("change")) / 2).alias("one_way"), F.sum(F.when(add, F.col("w1"))).alias("added_weight"), F.sum(F.when(gone, F.col("w0"))).alias("deleted_weight"),
        F.sum(F.when(~add & ~gone, F.abs("change"))).alias("drift"), F.count_if(add).alias("n_added"), F.count_if(gone).alias("n_deleted"),
    )


def carry_forward(calendar: DataFrame, observed: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """``calendar`` (key, day) with the last observation up to each day, and the days since it."""
    u = calendar.select(key, day, F.lit(None).cast("double").alias(value), F.lit(None).cast("date").alias("__o"), F.lit(True).alias("__c"))
    o = observed.select(key, day, F.col(value).cast("double").alias(value), F.col(day).cast("date").alias("__o"), F.lit(False).alias("__c")).where(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(day, "__c").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = u.unionByName(o).select(key, day, F.last(value, True).over(w).alias(value), F.last("__o", True).over(w).alias("__o"), "__c")
    return x.where("__c").select(key, day, value, F.datediff(day, "__o").alias("age_days"))


def nearest(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, left_id: str, right_id: str, window_days: int) -> DataFrame:
    """Two-sided nearest join: each left row with the right row of its key at most ``window_days`` away, the nearest, then the least id.

    Both sides meet on (key, bucket of window_days): a range of twice the window touches three
    buckets at most.
    """
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01")) / window_days)
    a = left.withColumn("__b", F.explode(F.array(*[bucket(left_day) + i for i in (-1, 0, 1)])))
    b = right.withColumn("__b", bucket(right_day))
    gap = F.abs(F.datediff(left_day, right_day))
    j = a.join(b, [key, "__b"]).where(gap <= window_days)
    return j.groupBy(left_id).agg(F.min(F.struct(gap.alias("gap"), F.col(right_id).alias(right_id))).alias("s")).select(left_id, F.col(f"s.{right_id}").alias(right_id), F.col("s.gap").alias("gap"))
