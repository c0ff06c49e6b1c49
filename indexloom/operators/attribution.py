"""Return attribution between two weight vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def brinson(df: DataFrame, by: Sequence[str], group: str, portfolio: str, benchmark: str, ret: str) -> DataFrame:
    """Allocation, selection and interaction per (by, group) from weights that each sum to 1 within ``by``.

    Effects add up to the active return of ``by``. A group absent from a side has weight 0 and the
    other side's return there.
    """
    w0, w1 = F.coalesce(F.col(benchmark), F.lit(0.0)), F.coalesce(F.col(portfolio), F.lit(0.0))
    g = df.groupBy(*by, group).agg(F.sum(w1).alias("wp"), F.sum(w0).alias("wb"), F.sum(w1 * F.col(ret)).alias("cp"), F.sum(w0 * F.col(ret)).alias("cb"))
    rb0, rp0 = F.try_divide("cb", F.nullif("wb", F.lit(0.0))), F.try_divide("cp", F.nullif("wp", F.lit(0.0)))
    g = g.withColumn("rb", F.coalesce(rb0, rp0, F.lit(0.0))).withColumn("rp", F.coalesce(rp0, rb0, F.lit(0.0)))
    total = g.groupBy(*by).agg(F.sum("cb").alias("total_b"), F.sum("cp").alias("total_p"))
    x = g.join(total, list(by))
    return x.select(
        *by, group, ((F.col("wp") - F.col("wb")) * (F.col("rb") - F.col("total_b"))).alias("allocation"), (F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        ((F.col("wp") - F.col("wb")) * (F.col("rp") - F.col("rb"))).alias("interaction"), (F.col("total_p") - F.col("total_b")).alias("active"),
    )


def active_share(df: DataFrame, by: Sequence[str], portfolio: str, benchmark: str) -> DataFrame:
    """Half the sum of absolute weight differences per ``by``."""
    d = F.abs(F.coalesce(F.col(portfolio), F.lit(0.0)) - F.coalesce(F.col(benchmark), F.lit(0.0)))
    return df.groupBy(*by).agg((F.sum(d) / 2).alias("active_share"), F.count_if(F.coalesce(F.col(portfolio), F.lit(0.0)) > 0).alias("n_held"))


def factor_attribution(active: DataFrame, exposures: DataFrame, factors: DataFrame) -> DataFrame:
    """Active weight times exposure times factor return, per factor: joins that keep to one row per (name, factor)."""
    return active.join(exposures, "security_id").groupBy("factor").agg(F.sum(F.col("active") * F.col("exposure")).alias("exposure")).join(factors, "factor").withColumn("contribution", F.col("exposure") * F.col("ret"))
