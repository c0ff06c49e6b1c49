"""Rolling totals over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_totals(rows: DataFrame, *, entity: str, day: str, amount: Column, prefer: Column) -> DataFrame:
    """One total per (entity, day): the ``amount`` of the copy with the greatest ``prefer``.

    Copies of a day are merged by a map-side combinable maximum; a null ``prefer`` loses to any
    other; between equal ones the greater amount is taken; a null amount adds nothing (0).
    Rows without entity or day are no activity of anyone and are left out.
    """
    d = rows.select(F.col(entity).alias("e"), F.to_date(day).alias("d"), F.struct(prefer.alias("p"), amount.alias("a")).alias("s"))
    g = d.where(F.col("e").isNotNull() & F.col("d").isNotNull()).groupBy("e", "d").agg(F.max("s").alias("s"))
    return g.select(F.col("e").alias("entity"), F.col("d").alias("day"), F.coalesce(F.col("s.a"), F.lit(0.0)).alias("amount"))


def entity_calendar(totals: DataFrame, tail_days: int = 0) -> DataFrame:
    """The span of days from an entity's first total to ``tail_days`` after its last: (entity, first, last)."""
    return totals.groupBy("entity").agg(F.min("day").alias("first"), F.date_add(F.max("day"), tail_days).alias("last"))


def trailing(calendar: DataFrame, totals: DataFrame, windows: Sequence[int]) -> DataFrame:
    """For each (entity, day) of ``calendar`` the totals of the trailing ``windows`` days.

    ``calendar`` holds days (entity, day) or spans of days (entity, first, last), which must not
    overlap within an entity. Columns: entity, day, ``total_w`` and ``average_w`` (total over w
    days) for each window w, and ``active_w``, the days with a total. Days without totals give 0.

    Range join on coarse date buckets, twice as long as the longest window: spans are cut at the
    borders of buckets, a total goes to its own bucket and, if a trailing range of the next one
    can hold it, to that as well. Both sides meet on (entity, bucket), which also spreads a busy
    entity over its buckets; the range is a condition of the join, and the days of a span are only
    written out there, one per day and total within its bounds, and summed without a further
    exchange.

    Calendar rows without entity or day are left out; repeated ones count once.
    """
    w = max(windows)
    width = 2 * w
    span = calendar.select("entity", F.unix_date("day").alias("f"), F.unix_date("day").alias("l")) if "day" in calendar.columns else calendar.select("entity", F.unix_date("first").alias("f"), F.unix_date("last").alias("l"))
    bucket = lambda c: F.floor(c / width).cast("int")
    chunk = span.dropna().distinct().withColumn("b", F.explode(F.sequence(bucket(F.col("f")), bucket(F.col("l")))))
    chunk = chunk.select("entity", "b", F.greatest("f", F.col("b") * width).alias("f"), F.least("l", F.col("b") * width + (width - 1)).alias("l"))
    x = F.unix_date("day")
    part = totals.select(F.col("entity").alias("e"), x.alias("x"), "amount", F.explode(F.sequence(bucket(x), bucket(x + (w - 1)))).alias("c"))
    # a chunk meets its totals once, and once nothing (``idle``): that row writes out all its days
    tasks = int(calendar.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # chunks are few and short but become many days: AQE must not merge their tasks
    both = chunk.repartition(tasks, "entity", "b").withColumn("idle", F.explode(F.array(F.lit(True), F.lit(False))))
    meets = (F.col("entity") == F.col("e")) & (F.col("b") == F.col("c")) & ~F.col("idle") & (F.col("x") <= F.col("l")) & (F.col("x") > F.col("f") - w)
    days = F.when(F.col("idle"), F.sequence("f", "l")).when(F.col("x").isNotNull(), F.sequence(F.greatest("f", "x"), F.least("l", F.col("x") + (w - 1))))
    hit = both.join(part, meets, "left").select("entity", "b", "x", "amount", F.explode(days).alias("d"))
    inside = lambda n: F.col("d") - F.col("x") < n
    g = hit.groupBy("entity", "b", "d").agg(*[F.sum(F.when(inside(n), F.col("amount"))).alias(f"s{n}") for n in windows], *[F.count_if(inside(n)).alias(f"active_{n}") for n in windows])
    total = {n: F.coalesce(F.col(f"s{n}"), F.lit(0.0)) for n in windows}
    return g.select("entity", F.date_from_unix_date("d").alias("day"), *[total[n].alias(f"total_{n}") for n in windows], *[(total[n] / n).alias(f"average_{n}") for n in windows], *[f"active_{n}" for n in windows])
