"""Overlapping and gapped intervals: continuous periods and the gaps between them.

The state of an entity is a list of disjoint intervals in order. Two states merge by one linear
pass over their sorted union, so partial lists combine in any grouping: by start day, by stretch
of years, by entity. The list of an entity never holds more than one interval per start day,
which bounds every merge by the calendar however many rows an entity has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 9999-12-31 as days since 1970-01-01, the end of an interval that is still open.
OPEN = 2932896
ITEM = "struct<f:int,e:int,m:boolean>"


def merge_lists(items: pa.Array) -> pa.Array:
    """Merges each row's concatenated partial lists into one list of disjoint intervals in order.

    An item is (f, e, m): the half-open days [f, e) and whether more than one different interval
    went into it. Touching items join. A merged item is multiple unless all that went into it are
    single and equal to it.
    """
    lens = np.diff(items.offsets.to_numpy())
    if not lens.sum():
        return items
    s = items.flatten()
    f, e, m = (s.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    row = np.repeat(np.arange(len(lens)), lens)
    o = np.lexsort((e, f, row))
    f, e, m, row = f[o], e[o], m[o].astype(bool), row[o]
    shift = row.astype(np.int64) << 33
    reach = np.maximum.accumulate(e + shift)
    new = np.r_[True, (f + shift)[1:] > reach[:-1]]
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    start, end = f[at], np.maximum.reduceat(e, at)
    multi = np.logical_or.reduceat(m | (f != start[group]) | (e != end[group]), at)
    offsets = np.r_[0, np.cumsum(np.bincount(row[at], minlength=len(lens)))]
    out = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(multi)], names=["f", "e", "m"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), out)


def _merge() -> Column:
    def merged(items: pa.Array) -> pa.Array:
        return merge_lists(items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items)

    return F.arrow_udf(merged, f"array<{ITEM}>")


def interval_days(start: str, end: str) -> tuple[Column, Column, Column]:
    """Start and end as days, and whether they describe anything: start set, end open (null or 9999-12-31) or after it."""
    e = F.coalesce(F.unix_date(F.to_date(end)), F.lit(OPEN))
    return F.unix_date(F.to_date(start)), e, F.col(start).isNotNull() & (F.unix_date(F.to_date(start)) < e)


def coverage(rows: DataFrame, *, entity: Sequence[str], start: str, end: str, branch_days: int = 1461) -> DataFrame:
    """Per entity the ``periods``: its disjoint intervals (f, e, m) in order, days since 1970-01-01.

    Reduction tree: leaves combine the rows of one start day (map-side), branches the leaves of
    ``branch_days``, the root the branches of the entity. Defined cases: a null start, an end not
    after the start and rows with a null in the entity describe nothing; a null end and
    9999-12-31 both mean open; repeated rows count once; touching intervals join; an empty table
    gives no rows; other columns are ignored.
    """
    f, e, real = interval_days(start, end)
    k = [f"k{i}" for i in range(len(entity))]
    d = rows.where(real).select(*[F.col(c).alias(n) for c, n in zip(entity, k, strict=True)], f.alias("f"), e.alias("e")).dropna()
    leaf = d.groupBy(*k, "f").agg(F.max("e").alias("e"), F.min("e").alias("least"))
    item = F.struct("f", "e", (F.col("e") != F.col("least")).alias("m"))
    merge = _merge()
    branch = leaf.groupBy(*k, F.floor(F.col("f") / branch_days).alias("b")).agg(F.collect_list(item).alias("s")).select(*k, merge("s").alias("s"))
    root = branch.groupBy(*k).agg(F.flatten(F.collect_list("s")).alias("s")).select(*k, merge("s").alias("periods"))
    return root.select(*[F.col(n).alias(c) for c, n in zip(entity, k, strict=True)], "periods")


def gaps(periods: Column) -> Column:
    """The complement inside a list of periods: array<struct<f,e>>, empty for fewer than two."""
    pairs = F.transform(F.slice(periods, 2, F.greatest(F.size(periods) - 1, F.lit(0))), lambda p, i: F.struct(F.get(periods, i)["e"].alias("f"), p["f"].alias("e")))
    return F.coalesce(pairs, F.array().cast("array<struct<f:int,e:int>>"))


def spans(cover: DataFrame, entity: Sequence[str]) -> DataFrame:
    """Rows of :func:`coverage` as spans: kind ``period`` or ``gap``, from, to (null when open), ``multiple``."""
    p = F.transform("periods", lambda x: F.struct(F.lit("period").alias("kind"), x["f"].alias("f"), x["e"].alias("e"), x["m"].alias("m")))
    g = F.transform(gaps(F.col("periods")), lambda x: F.struct(F.lit("gap").alias("kind"), x["f"].alias("f"), x["e"].alias("e"), F.lit(False).alias("m")))
    s = cover.select(*entity, F.explode(F.concat(p, g)).alias("__s"))
    to = F.when(F.col("__s.e") < OPEN, F.date_from_unix_date("__s.e"))
    return s.select(*entity, F.col("__s.kind").alias("span_kind"), F.date_from_unix_date("__s.f").alias("span_from"), to.alias("span_to"), F.col("__s.m").alias("multiple"))
