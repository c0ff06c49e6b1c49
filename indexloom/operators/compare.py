"""Comparing frames: content hashes, reconciliation, golden masters, quality findings."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: ``n_rows`` and a ``content_hash`` that depends on the rows and not on their order.

    Sums of row hashes in DECIMAL, so nothing overflows and partial sums combine map-side.
    """
    cols = sorted(columns or df.columns)
    h = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string").alias("content_hash"))


def reconcile(ours: DataFrame, theirs: DataFrame, key: str, weight: str, tolerance: float) -> DataFrame:
    """Both sides renormalised and joined: key, ours, theirs, difference, category."""

    def share(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy(key).agg(F.sum(weight).alias("w")).select(key, (F.col("w") / d.agg(F.sum(weight)).scalar()).alias(name))

    x = share(ours, "ours").join(share(theirs, "theirs"), key, "full")
    d = F.coalesce("ours", F.lit(0.0)) - F.coalesce("theirs", F.lit(0.0))
    kind = F.when(F.col("ours").isNull(), "only_theirs").when(F.col("theirs").isNull(), "only_ours").when(F.abs(d) > tolerance, "weight_differs").otherwise("match")
    return x.withColumn("difference", d).withColumn("category", kind)


def compare_runs(golden: DataFrame, candidate: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Per key the relative differences in basis points, and whether a side lacks it: key, status, ``bps_<column>``, worst_bps."""
    g = golden.select(key, *[F.col(c).alias(f"g_{c}") for c in columns], F.lit(True).alias("__g"))
    c = candidate.select(key, *[F.col(c).alias(f"c_{c}") for c in columns], F.lit(True).alias("__c"))
    x = g.join(c, key, "full")
    bps = {n: F.abs(F.try_divide(F.col(f"c_{n}"), F.nullif(F.col(f"g_{n}"), F.lit(0.0))) - 1) * 10_000 for n in columns}
    status = F.when(F.col("__g").isNull(), "extra").when(F.col("__c").isNull(), "missing").otherwise("both")
    worst = F.greatest(*bps.values()) if len(bps) > 1 else next(iter(bps.values()))
    return x.select(key, status.alias("status"), *[b.alias(f"bps_{n}") for n, b in bps.items()], worst.alias("worst_bps"))


#: A rule: name, severity, condition of a bad row.
Rule = tuple[str, str, Column]


def findings(df: DataFrame, rules: Sequence[Rule], key: Column) -> DataFrame:
    """One row per rule: rule, severity, passed, n_bad, n_rows, and up to five of the bad keys in order.

    All rules of a table are checked in one pass. The sample is a bounded aggregate: bad keys are
    reduced to the five least per rule and task, and then of those. An empty table passes.
    """
    bad = F.array(*[F.struct(F.lit(i).alias("i"), F.coalesce(c, F.lit(False)).alias("b")) for i, (_, _, c) in enumerate(rules)])
    x = df.select(key.cast("string").alias("k"), F.explode(bad).alias("r")).select("k", "r.i", "r.b")
    g = x.groupBy("i").agg(F.count_if("b").alias("n_bad"), F.count(F.lit(1)).alias("n_rows"), least_five(F.when(F.col("b"), F.col("k"))).alias("s"))
    names = df.sparkSession.createDataFrame([(i, n, s) for i, (n, s, _) in enumerate(rules)], "i int, rule string, severity string")
    g = names.join(g, "i", "left").withColumns({"n_bad": F.coalesce("n_bad", F.lit(0)), "n_rows": F.coalesce("n_rows", F.lit(0))})
    return g.select("rule", "severity", (F.col("n_bad") == 0).alias("passed"), "n_bad", "n_rows", F.coalesce(F.array_join("s", ","), F.lit("")).alias("sample"))


def least_five(key: Column) -> Column:
    """The five least different values of a column, in order."""
    return F.slice(F.array_sort(F.collect_set(key)), 1, 5)


def guarded(name: str, check: Callable[[], DataFrame], spark: SparkSession) -> DataFrame:
    """The findings of a check; one that cannot be run is itself a finding that blocks."""
    try:
        return check()
    except Exception as e:  # noqa: BLE001
        return spark.createDataFrame([(name, "BLOCK", False, 1, 0, type(e).__name__)], "rule string, severity string, passed boolean, n_bad bigint, n_rows bigint, sample string")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of copies."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def robust_outliers(df: DataFrame, group: str, value: str, sigmas: float) -> DataFrame:
    """Rows further than ``sigmas`` robust deviations (1.4826 MAD) from their group's median.

    Two aggregations over the group and two joins back; medians are exact.
    """
    m = df.groupBy(group).agg(F.median(value).alias("__m"))
    x = df.join(m, group)
    s = x.groupBy(group).agg(F.median(F.abs(F.col(value) - F.col("__m"))).alias("__s"))
    z = F.try_divide(F.abs(F.col(value) - F.col("__m")), F.nullif(1.4826 * F.col("__s"), F.lit(0.0)))
    return x.join(s, group).withColumn("robust_z", z).where(F.col("robust_z") > sigmas).drop("__m", "__s")


def gate(findings: DataFrame, levels: Mapping[str, int]) -> DataFrame:
    """One row: the gravest failed severity's decision and the counts by severity."""
    rank = reduce(lambda a, b: a.when(F.col("severity") == b[0], b[1]), levels.items(), F.when(F.lit(False), 0)).otherwise(0)
    names = F.create_map(*[F.lit(v) for k, n in levels.items() for v in (n, k)])
    g = findings.agg(F.max(F.when(~F.col("passed"), rank)).alias("r"), F.count(F.lit(1)).alias("n_rules"), F.count_if(~F.col("passed")).alias("n_failed"))
    return g.select(F.coalesce(names[F.col("r")], F.lit("OK")).alias("decision"), "n_rules", "n_failed")
