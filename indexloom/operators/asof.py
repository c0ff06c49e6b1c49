"""Attributes as known at event time: which version of an attribute was in force when an event happened.

A version enters the picture at its *activation time* and from then on competes with the
versions before it; the one in force at time k is the greatest (by ``order``) of all versions
active by k. That is a running maximum over time, which is mergeable, so an entity's time line
can be cut anywhere: a shard only needs the greatest version of all shards before it (its
carry-in) to give the same answers as the uncut line. Every entity is cut at the same borders,
so there is no threshold from which an entity counts as hot: a busy one simply has more shards.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in the columns, as plain conditions that the optimizer does not have to infer again."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


class _Rank:
    """``order`` columns as one comparable value: two dates fit a bigint, which hash aggregates hold; others stay a struct."""

    def __init__(self, versions: DataFrame, order: Sequence[str]):
        self.order = list(order)
        self.packed = len(self.order) <= 2 and all(isinstance(versions.schema[c].dataType, DateType) for c in self.order)

    def pack(self) -> Column:
        if not self.packed:
            return F.struct(*[F.col(c) for c in self.order])
        days = [F.unix_date(F.col(c)).cast("bigint") for c in self.order]
        return days[0] if len(days) == 1 else days[0] * (1 << 32) + (days[1] + (1 << 31))

    def unpack(self, c: str) -> Column:
        if not self.packed:
            return F.col(c)
        v = F.col(c)
        if len(self.order) == 1:
            parts = [v]
        else:
            parts = [F.shiftright(v, 32), v.bitwiseAND((1 << 32) - 1) - (1 << 31)]
        return F.when(v.isNotNull(), F.struct(*[F.date_from_unix_date(p.cast("int")).alias(n) for p, n in zip(parts, self.order, strict=True)]))


def as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: Sequence[str],
    event_time: str,
    order: Sequence[str],
    clocks: Mapping[str, Column],
    variants: Mapping[str, Sequence[str]] | None = None,
    shard_days: float = 366,
) -> DataFrame:
    """For each distinct (entity, event time, variant): the version in force, per clock.

    ``clocks`` maps an output name to the activation time of a version (a Column over
    ``versions``); ``order`` ranks versions; ``variants`` are further key columns of ``versions``
    whose listed values every event is asked for. Returns the keys, ``event_time`` and one struct
    of the ``order`` columns per clock (null where nothing was known).

    Physical plan: events and versions are reduced to one row per key and instant (map-side
    combine) and both exchanges are used twice: their rows go to their (entity, shard of
    ``shard_days``), and one row per (key, shard) with its greatest version goes to a window over
    shards that gives each shard the last preceding version as a carry-in row. Shards then merge
    locally, independent of each other; events are asked for their variants only there. No side is
    broadcast and no pair is emitted. ``shard_days`` bounds what one task sorts of an entity at
    a time; it may be a fraction for event times finer than days.

    Defined cases: events without key or time are not asked; versions with a null in key,
    ``order`` or clock are never in force; repeated rows and ties count once; a version active on
    the event's own instant counts; empty tables give an empty result; all other columns are
    ignored, so their names cannot clash.
    """
    variants = dict(variants or {})
    names, rank = list(clocks), _Rank(versions, order)
    k, w, v = [f"k{i}" for i in range(len(entity))], [f"w{i}" for i in range(len(variants))], [f"v{i}" for i in range(len(names))]
    seconds = round(shard_days * 86_400)

    def shard(df: DataFrame, days: bool) -> DataFrame:
        if days:
            return df.withColumn("shard", F.floor(F.unix_date("t") / (seconds / 86_400)))
        return df.withColumn("t", F.col("t").cast("timestamp")).withColumn("shard", F.floor(F.unix_seconds("t") / seconds))

    ev = events.select(*[F.col(c).alias(n) for c, n in zip(entity, k, strict=True)], F.col(event_time).alias("t"))
    ev = _present(ev, [*k, "t"]).distinct()
    ve = versions.select(
        *[F.col(c).alias(n) for c, n in zip([*entity, *variants], [*k, *w], strict=True)],
        rank.pack().alias("v"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("t")) for i, c in enumerate(clocks.values())])).alias("c"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
    )
    ve = _present(ve, [*k, *w, *[f"o{i}" for i in range(len(order))]])
    for n, values in zip(w, variants.values(), strict=True):
        ve = ve.where(F.col(n).isin(*values))
    ve = ve.where(F.col("c.t").isNotNull()).groupBy(*k, *w, F.col("c.t").alias("t")).agg(*[F.max(F.when(F.col("c.i") == i, F.col("v"))).alias(n) for i, n in enumerate(v)])
    days = all(isinstance(x.schema["t"].dataType, DateType) for x in (ve, ev))
    ve, ev = shard(ve, days), shard(ev, days)

    line = ve.withColumn("asked", F.lit(False)).unionByName(ev.withColumn("asked", F.lit(True)), allowMissingColumns=True)
    asked_for = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(c, w, strict=True)]) for c in product(*variants.values())]) if w else None

    def with_variants(df: DataFrame) -> DataFrame:
        if not w:
            return df
        own = F.array(F.struct(*[F.col(n) for n in w]))
        return df.withColumn("w", F.explode(F.when(F.col("asked"), asked_for).otherwise(own))).select(*[c for c in df.columns if c not in w], *[F.col(f"w.{n}").alias(n) for n in w])

    key = [*k, *w]
    last = with_variants(line).groupBy(*key, "shard").agg(*[F.max(n).alias(n) for n in v])
    before = Window.partitionBy(*key).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*key, "shard", *[F.max(n).over(before).alias(n) for n in v]).where(F.coalesce(*v).isNotNull())
    carry = carry.withColumn("asked", F.lit(False)).withColumn("t", F.lit(None).cast(line.schema["t"].dataType))
    spread = with_variants(line.unionByName(carry).repartition(*k, "shard"))
    # the carry-in comes first, and a version of an event's own instant before the event
    local = Window.partitionBy(*key, "shard").orderBy(F.asc_nulls_first("t"), "asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = spread.select(*key, "t", "asked", *[F.max(n).over(local).alias(n) for n in v])
    return merged.where("asked").select(
        *[F.col(n).alias(c) for c, n in zip([*entity, *variants], key, strict=True)], F.col("t").alias(event_time), *[rank.unpack(n).alias(c) for c, n in zip(names, v, strict=True)]
    )
