"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Every document gets an exponential key whose rate is its quality weight; the smallest keys come
first, which draws documents without replacement in proportion to their weights. A source whose
budget exceeds its tokens uses all its documents in complete epochs first; the rest of the budget
is met from the front of its key order by a prefix sum. The prefix sum runs in two levels (key
ranges of a source, then documents of a range), so a source with a third of all documents is
spread over all ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import cut
from .residue import host_of


def unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on key and seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target: ``source``, ``target_share``, ``max_repeats``, ``available``, ``budget``, ``wanted``, ``epochs``, ``rest``.

    Without ``total_tokens`` the total is the largest at which every source that has tokens reaches
    its share within its repeats, so that shares are met exactly. With it, a source gives at most
    ``max_repeats`` times what it has. One row per source; nothing here grows with the data.
    """
    have = sized.where("n > 0").groupBy("h").agg(F.sum("n").alias("available"))
    t = targets.where("source IS NOT NULL").groupBy(host_of(F.col("source")).alias("h")).agg(
        F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("repeats")
    )
    b = t.join(have, "h", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.when((F.col("available") > 0) & (F.col("share") > 0) & (F.col("repeats") > 0), F.col("repeats") * F.col("available") / F.col("share"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.coalesce(F.min(most).over(Window.partitionBy(F.lit(0))), F.lit(0.0))
    b = b.withColumn("wanted", F.floor(F.col("share") * total + 1e-6)).withColumn("budget", F.least("wanted", F.col("repeats") * F.col("available")).cast("long"))
    epochs = F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("int")
    return b.select("h", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "available", "budget", "wanted", epochs.alias("epochs")).withColumn(
        "rest", F.col("budget") - F.col("epochs") * F.col("available")
    )


def mix(
    sized: DataFrame, targets: DataFrame, *, key: str = "doc_id", source: str = "source", size: str = "n_tokens", weight: str | None = None, total_tokens: int | None = None, seed: int = 17, ranges: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(drawn, report): the drawn documents with their number of ``uses``, and the share each target reached.

    The document that straddles the end of a budget is taken if that misses the budget by less.
    Report: ``source``, ``target_share``, ``reached_share``, ``tokens``, ``budget``, ``available``,
    ``documents``, ``max_repeats``, ``most_uses``, ``short`` (true where a source lacks what its share needs).

    Defined cases: sources are compared in lower case, trimmed, with underscores; documents of a
    null or untargeted source and of size 0 or null are never drawn; a null, NaN or non-positive
    weight counts as the smallest (1e-6); equal keys are ordered by document key; repeated targets add up; a
    target without documents reaches 0 and is short; empty tables give empty results.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    w = F.when((w > 0) & (w < float("inf")), w).otherwise(F.lit(1e-6))
    d = sized.select(F.col(key).alias("k"), host_of(F.col(source)).alias("h"), F.col(size).cast("long").alias("n"), w.alias("w"))
    d = cut(d.where(F.col("n") > 0))
    plan = budgets(d, targets, total_tokens)
    spark = sized.sparkSession
    ranges = ranges or max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    mean = d.groupBy("h").agg(F.avg("w").alias("mean"))
    few = F.broadcast(plan.join(mean, "h"))  # one row per target
    keyed = d.join(few, "h").where("budget > 0").withColumn("key", -F.log(unit(F.col("k"), seed)) / F.col("w"))
    keyed = keyed.withColumn("b", F.least(F.floor((1 - F.exp(-F.col("key") * F.col("mean"))) * ranges), F.lit(ranges - 1)).cast("int"))
    sums = keyed.groupBy("h", "b").agg(F.sum("n").alias("s"))
    before = sums.select("h", "b", F.coalesce(F.sum("s").over(Window.partitionBy("h").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("n").over(Window.partitionBy("h", "b").orderBy("key", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = keyed.join(before, ["h", "b"]).withColumn("ahead", own + F.col("before"))
    once_more = (F.col("rest") > 0) & (F.col("epochs") < F.col("max_repeats")) & (F.col("ahead") + F.col("n") / 2 <= F.col("rest"))
    drawn = placed.withColumn("uses", F.col("epochs") + once_more.cast("int")).where("uses > 0").select(F.col("k").alias(key), F.col("h").alias(source), F.col("n").cast("int").alias(size), "uses")
    got = drawn.groupBy(F.col(source).alias("h")).agg(F.sum(F.col(size).cast("long") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    r = plan.join(got, "h", "left").fillna(0, ["tokens", "documents", "most_uses"])
    all_tokens = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    report = r.select(
        F.col("h").alias(source), "target_share", F.coalesce(F.try_divide("tokens", all_tokens), F.lit(0.0)).alias("reached_share"), "tokens", "budget", "available", "documents", "max_repeats", "most_uses",
        ((F.col("target_share") > 0) & ((F.col("available") * F.col("max_repeats") == 0) | (F.col("wanted") > F.col("budget")))).alias("short"),
    )
    return drawn, report
