"""Filling fixed-capacity containers: a best-fit plan over a histogram of lengths.

The plan works on counts, so its cost depends on the number of different lengths (at most the
largest capacity) and not on the number of documents. It hands out ranges of ranks: the i-th
document of a length has exactly one planned slot, and documents find theirs by their rank within
their length. Ranks are built in two levels (shards of a length, then documents of a shard), so a
length that a third of all documents share is never ordered in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import cut


@dataclass
class Plan:
    """Slots and containers.

    ``slots`` rows (length, first rank, count, first container, items per container, offset):
    the item of rank r goes to container ``first container + (r - first rank) // per`` at token
    ``offset + (r - first rank) % per * length``. ``containers`` rows (first, count, capacity,
    used) describe runs of equal containers.
    """

    slots: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    containers: list[tuple[int, int, int, int]] = field(default_factory=list)

    def unused(self) -> int:
        return sum(n * (c - u) for _, n, c, u in self.containers)


class _Open:
    """Open containers by remaining space; a group is a run of equal containers (first, count, capacity)."""

    def __init__(self) -> None:
        self.left: list[int] = []
        self.groups: dict[int, list[tuple[int, int, int]]] = {}

    def put(self, remaining: int, group: tuple[int, int, int]) -> None:
        if remaining not in self.groups:
            insort(self.left, remaining)
            self.groups[remaining] = []
        self.groups[remaining].append(group)

    def best(self, length: int) -> tuple[int, tuple[int, int, int]] | None:
        i = bisect_left(self.left, length)
        if i == len(self.left):
            return None
        r = self.left[i]
        group = self.groups[r].pop()
        if not self.groups[r]:
            del self.groups[r], self.left[i]
        return r, group


def plan_best_fit(counts: Mapping[int, int], capacities: Sequence[int], open_largest: bool = True) -> Plan:
    """Best fit, longest first: every item goes to the open container it leaves the least space in.

    A new container is opened at the largest capacity, or at the smallest that holds the item; in
    the end every container takes the smallest capacity that holds its content. Lengths must not
    exceed the largest capacity. Items of length 0 share one container.
    """
    sizes = sorted(set(capacities))
    plan, opened, next_id = Plan(), _Open(), 0
    for length in sorted((x for x, n in counts.items() if n > 0), reverse=True):
        if length > sizes[-1]:
            raise ValueError(f"an item of {length} exceeds the largest capacity {sizes[-1]}")
        n, rank = counts[length], 0
        while n:
            found = opened.best(length)
            if found is None:
                capacity = sizes[-1] if open_largest else next(c for c in sizes if c >= length)
                per = n if length == 0 else capacity // length
                found = capacity, (next_id, -(-n // per), capacity)
                next_id += found[1][1]
            remaining, (first, have, capacity) = found
            per = n if length == 0 else remaining // length
            full = min(have, n // per)
            if full:
                plan.slots.append((length, rank, full * per, first, per, capacity - remaining))
                opened.put(remaining - per * length, (first, full, capacity))
                rank, n, first, have = rank + full * per, n - full * per, first + full, have - full
            if have and n and n < per:
                plan.slots.append((length, rank, n, first, n, capacity - remaining))
                opened.put(remaining - n * length, (first, 1, capacity))
                n, first, have = 0, first + 1, have - 1
            if have:
                opened.put(remaining, (first, have, capacity))
    for remaining, groups in opened.groups.items():
        for first, n, capacity in groups:
            used = capacity - remaining
            plan.containers.append((first, n, next(c for c in sizes if c >= used), used))
    return plan


def best_plan(counts: Mapping[int, int], capacities: Sequence[int]) -> Plan:
    """The one of the two opening rules that leaves less unused space."""
    return min((plan_best_fit(counts, capacities, x) for x in (True, False)), key=Plan.unused)


def ranks_within(items: DataFrame, group: str, order: Sequence[str], shards: int) -> DataFrame:
    """``items`` with ``rank`` (from 0) within ``group``: by shard, then by ``order``.

    Shards are hashes of the ``order`` columns, which must identify a row. The offset of a shard
    is a running sum over at most ``shards`` counts of its group.
    """
    x = items.withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards)))
    counts = x.groupBy(group, "__shard").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__shard", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy(group, "__shard").orderBy(*order)) - 1
    return x.join(offsets, [group, "__shard"]).withColumn("rank", own + F.col("__before")).drop("__shard", "__before")


#: Ranks of a length that share a join key with the slots planned for them.
BLOCK = 4096


def slot_blocks(spark: SparkSession, plan: Plan) -> DataFrame:
    """The planned slots as a table to join documents with by ``length`` and ``block`` of rank: ranks ``from`` <= rank < ``to``, ``container`` of the first, items ``per`` container, ``offset``, ``capacity``.

    A slot is cut where the capacity of its containers changes, and written out once per block of
    ranks, by Spark and not by the driver, whose table has one row per entry of the plan.
    """
    slots = np.array(sorted(plan.slots), np.int64).reshape(-1, 6)
    made = np.array(sorted(plan.containers), np.int64).reshape(-1, 4)
    length, first, count, container, per, offset = slots.T
    last = container + (count - 1) // per
    a, b = np.searchsorted(made[:, 0], container, "right") - 1, np.searchsorted(made[:, 0], last, "right") - 1
    row = np.repeat(np.arange(len(slots)), b - a + 1)
    run = np.arange(len(row)) - np.repeat(np.cumsum(b - a + 1) - (b - a + 1), b - a + 1) + a[row]
    start = np.maximum(container[row], made[run, 0])
    end = np.minimum(last[row], made[run, 0] + made[run, 1] - 1)
    begin = first[row] + (start - container[row]) * per[row]
    to = np.minimum(first[row] + count[row], first[row] + (end + 1 - container[row]) * per[row])
    t = pa.table({"length": length[row].astype(np.int32), "from": begin, "to": to, "container": start, "per": per[row], "offset": offset[row], "capacity": made[run, 2].astype(np.int32)})
    blocks = F.sequence(F.floor(F.col("from") / BLOCK), F.floor((F.col("to") - 1) / BLOCK))
    return spark.createDataFrame(t).withColumn("block", F.explode(blocks))


def pack(sized: DataFrame, capacities: Mapping[str, int], *, key: str = "doc_id", size: str = "n_tokens", shards: int | None = None) -> DataFrame:
    """Every item with its container: ``key``, ``piece``, ``size``, ``first_token``, ``container_id``, ``pack_name``, ``capacity``, ``offset``.

    An item larger than the largest capacity is cut into full containers and a rest, which is
    packed like any other; all others stay whole and come out once (piece 0). The collected
    histogram and the plan have at most one entry per length and open space: their bound is the
    largest capacity, not the data.

    Defined cases: a null or negative size counts as 0, and items of size 0 share a container; a
    repeated key would make two items one, so the key must be unique; a null key is an item like
    others; no capacities is an error; an empty table gives no rows; other columns are ignored.
    """
    names = sorted((c, n) for n, c in capacities.items() if c and c > 0)
    if not names:
        raise ValueError("no container sizes")
    largest = names[-1][0]
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    items = sized.select(F.col(key).alias("k"), n.alias("n"))
    last = F.greatest(F.ceil(F.col("n") / largest) - 1, F.lit(0)).cast("int")
    items = items.select("k", "n", F.explode(F.sequence(F.lit(0), last)).alias("piece")).select(
        "k", "piece", (F.col("piece").cast("long") * largest).alias("first"), F.least(F.col("n") - F.col("piece").cast("long") * largest, F.lit(largest)).cast("int").alias("length")
    )
    items = cut(items)
    counts = {r["length"]: r["c"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect()}
    plan = best_plan(counts, [c for c, _ in names])
    spark = sized.sparkSession
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ranks_within(items, "length", ["k", "piece"], shards).withColumn("block", F.floor(F.col("rank") / BLOCK))
    x = placed.join(slot_blocks(spark, plan), ["length", "block"]).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("to")))
    i = F.col("rank") - F.col("from")
    by_name = F.create_map(*[F.lit(v) for c, n in names for v in (c, n)])
    return x.select(
        F.col("k").alias(key), "piece", F.col("length").alias(size), F.col("first").alias("first_token"), (F.col("container") + F.floor(i / F.col("per"))).alias("container_id"),
        by_name[F.col("capacity")].alias("pack_name"), "capacity", (F.col("offset") + i % F.col("per") * F.col("length")).cast("int").alias("offset"),
    )
