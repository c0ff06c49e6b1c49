"""History of changing attributes: validity periods from presence bitmaps.

For every entity and attribute value a bitmap holds one bit per snapshot, set where the value was
present. A run of consecutive bits is one version; a snapshot without the value ends it, so gaps
and returning values need no special case.

Two kinds of input reach the bitmaps: periodic snapshot tables, whose snapshots are the distinct
snapshot days, and loose validity intervals, where an entity's snapshots are the stretches
between its own change days and the covering row that started last is the one present.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import OPEN, interval_days


def _in_force(at: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Per snapshot 0..n-1 the last of the rows that cover it, -1 for none; row i covers [at[i], to[i]).

    Every row marks the two power-of-two stretches that its own is made of, and marks are handed
    down from long stretches to their halves.
    """
    power = np.frexp((to - at).astype(float))[1] - 1
    row, best = np.arange(len(at)), np.full(n, -1, np.int64)
    for p in range(int(power.max(initial=0)), -1, -1):
        own = power == p
        np.maximum.at(best, at[own], row[own])
        np.maximum.at(best, to[own] - (1 << p), row[own])
        if p:
            half = 1 << (p - 1)
            best[half:] = np.maximum(best[half:], best[:-half].copy())
    return best


def _set_bits(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of every set bit, in order."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def bitmap_versions(entity: np.ndarray, f: np.ndarray, e: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Versions (entity, value, from, to), ordered by entity, of interval rows of many entities with different starts within each.

    An entity's snapshots are its own change days; each (entity, value) has 64-bit words with one
    bit per snapshot on which the value is in force, and runs of bits are versions.
    """
    o = np.lexsort((f, entity))
    entity, f, e, value = entity[o], f[o], e[o], value[o]
    span = 1 << 32
    axis = np.unique(np.r_[entity * span + f + (span >> 1), entity * span + e + (span >> 1)])
    day, owner = axis % span - (span >> 1), axis // span
    row = _in_force(np.searchsorted(axis, entity * span + f + (span >> 1)), np.searchsorted(axis, entity * span + e + (span >> 1)), len(axis))
    at = np.flatnonzero(row >= 0)
    first = np.searchsorted(owner, owner[at])
    key, local = owner[at] * (int(value.max(initial=0)) + 1) + value[row[at]], at - first
    o = np.lexsort((local, key))
    key, local, first = key[o], local[o], first[o]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (local[1:] // 64 != local[:-1] // 64)][: len(key)])
    words = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (local % 64).astype(np.uint64)), new) if len(new) else np.zeros(0, np.uint64)
    key, word, first = key[new], local[new] // 64, first[new]
    follows = np.r_[False, (key[1:] == key[:-1]) & (word[1:] == word[:-1] + 1)][: len(key)]
    top, one = np.uint64(63), np.uint64(1)
    before = np.where(follows, np.roll(words, 1) >> top, np.uint64(0))
    after = np.where(np.roll(follows, -1), np.roll(words, -1) << top, np.uint64(0))
    begins, ends = _set_bits(words & ~((words << one) | before)), _set_bits(words & ~((words >> one) | after))
    a, b = (first[w] + word[w] * 64 + bit for w, bit in (begins, ends))
    return owner[a], value[row[a]], day[a], day[b + 1]


def _versions(rows: pa.Array) -> pa.Array:
    at = rows.offsets.to_numpy().astype(np.int64)
    s = rows.flatten()
    f, e = (s.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
    code = s.field(2).dictionary_encode()
    entity, value, a, b = bitmap_versions(np.repeat(np.arange(len(rows)), np.diff(at)), f, e, code.indices.to_numpy(zero_copy_only=False).astype(np.int64))
    items = pa.StructArray.from_arrays([code.dictionary.take(pa.array(value)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["v", "f", "e"])
    counts = np.bincount(entity, minlength=len(rows))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), items)


def history_from_intervals(rows: DataFrame, *, entity: Sequence[str], value: Column, start: str, end: str) -> DataFrame:
    """All versions: the entity, ``value``, ``valid_from``, ``valid_to`` (null when open), ``n_versions`` of the entity.

    On any day the value in force is that of the covering row with the latest start. Rows of one
    entity and start day are first combined map-side into the one that can matter (the latest
    end, then the greatest value), so an entity's bitmap work is bounded by the calendar and not
    by its rows. Defined cases: a null start, value or key part, or an end not after the start,
    describes nothing; a null end and 9999-12-31 mean open; repeated rows count once; an empty
    table gives no rows; other columns are ignored.
    """
    f, e, real = interval_days(start, end)
    k = [f"k{i}" for i in range(len(entity))]
    d = rows.where(real).select(*[F.col(c).alias(n) for c, n in zip(entity, k, strict=True)], f.alias("f"), e.alias("e"), value.cast("string").alias("v")).dropna()
    best = d.groupBy(*k, "f").agg(F.max(F.struct("e", "v")).alias("s"))
    lists = best.groupBy(*k).agg(F.collect_list(F.struct("f", F.col("s.e").alias("e"), F.col("s.v").alias("v"))).alias("s"))
    versions = F.arrow_udf(_versions, "array<struct<v:string,f:int,e:int>>")
    x = lists.select(*k, versions("s").alias("s")).select(*k, F.explode("s").alias("x"), F.size("s").alias("n"))
    to = F.when(F.col("x.e") < OPEN, F.date_from_unix_date("x.e"))
    return x.select(*[F.col(n).alias(c) for c, n in zip(entity, k, strict=True)], F.col("x.v").alias("value"), F.date_from_unix_date("x.f").alias("valid_from"), to.alias("valid_to"), F.col("n").alias("n_versions"))


def history_from_snapshots(snapshots: DataFrame, *, entity: Sequence[str], value: Column, day: str) -> DataFrame:
    """Versions from a table of periodic snapshots: the entity, ``value``, ``first_seen``, ``last_seen``, ``n_snapshots``.

    A version is a run of consecutive snapshot days on which the entity shows the value; the
    snapshot days are the distinct days of the whole table. Presence is kept in 64-bit words
    aggregated map-side with a bitwise or, so repeated rows and hot entities collapse early.
    Defined cases: rows with a null in entity, value or day are absent; two values on one
    snapshot both have their bit; an empty table gives no rows.
    """
    k = [f"k{i}" for i in range(len(entity))]
    d = snapshots.select(*[F.col(c).alias(n) for c, n in zip(entity, k, strict=True)], value.cast("string").alias("v"), F.to_date(day).alias("d")).dropna()
    axis = d.select("d").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("d")) - 1)
    b = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 64).cast("int"))
    words = d.join(axis, "d").groupBy(*k, "v", F.floor(F.col("i") / 64).alias("w")).agg(F.bit_or(b).alias("b"))
    by = Window.partitionBy(*k, "v").orderBy("w")
    left = F.when(F.lag("w").over(by) == F.col("w") - 1, F.shiftrightunsigned(F.lag("b").over(by), 63)).otherwise(F.lit(0).cast("long"))
    right = F.when(F.lead("w").over(by) == F.col("w") + 1, F.shiftleft(F.lead("b").over(by), 63)).otherwise(F.lit(0).cast("long"))
    edge = words.select(
        *k,
        "v",
        "w",
        F.col("b").bitwiseAND(F.bitwise_not(F.shiftleft("b", 1).bitwiseOR(left))).alias("s"),
        F.col("b").bitwiseAND(F.bitwise_not(F.shiftrightunsigned("b", 1).bitwiseOR(right))).alias("e"),
    )

    def positions(c: str) -> Column:
        own = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col(c), i).bitwiseAND(1) == 1)
        return F.array_sort(F.flatten(F.collect_list(F.transform(own, lambda i: (F.col("w") * 64 + i).cast("int")))))

    runs = edge.groupBy(*k, "v").agg(positions("s").alias("s"), positions("e").alias("e"))
    runs = runs.select(*k, "v", F.explode(F.arrays_zip("s", "e")).alias("r")).select(*k, "v", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    first, last = axis.select(F.col("d").alias("first_seen"), F.col("i").alias("s")), axis.select(F.col("d").alias("last_seen"), F.col("i").alias("e"))
    x = runs.join(first, "s").join(last, "e")
    return x.select(*[F.col(n).alias(c) for c, n in zip(entity, k, strict=True)], F.col("v").alias("value"), "first_seen", "last_seen", (F.col("e") - F.col("s") + 1).alias("n_snapshots"))
