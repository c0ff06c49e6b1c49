"""Inputs that several query modules share, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table


def text_day(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def rounded(c: str | Column, n: int = 6) -> Column:
    return F.round(c, n)


def clean_prices(spark: SparkSession, d: str) -> DataFrame:
    """One positive finite close per listing and day: the copy with the greatest volume, then close."""
    p = table(spark, d, "prices").where("close > 0 AND close < double('Infinity')")
    g = p.groupBy("listing_id", "date").agg(F.max(F.struct("volume", "close", "security_id")).alias("s"))
    return g.select("listing_id", "date", "s.close", "s.volume", "s.security_id")


CLEAN = """cp AS (SELECT listing_id, date, close, volume, security_id FROM prices WHERE close > 0 AND isfinite(close)
 QUALIFY row_number() OVER (PARTITION BY listing_id, date ORDER BY volume DESC NULLS LAST, close DESC, security_id DESC NULLS LAST) = 1)"""


def fx(spark: SparkSession, d: str) -> DataFrame:
    """A gappy exchange-rate table derived from orders: date, quote, rate."""
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    x = o.join(c, o.o_custkey == c.c_custkey).join(n, n.n_nationkey == c.c_nationkey).join(r, r.r_regionkey == n.n_regionkey)
    return x.groupBy(F.to_date("o_orderdate").alias("date"), F.col("r_name").alias("quote")).agg((F.avg("o_totalprice") / 200000.0).alias("rate"))


FX = """fx AS (SELECT CAST(o.o_orderdate AS DATE) AS date, r.r_name AS quote, AVG(o.o_totalprice) / 200000.0 AS rate
 FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY 1, 2)"""


def signals(spark: SparkSession, d: str) -> DataFrame:
    """A monthly signal per customer with its segment: as_of, security_id, signal, industry."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    s = o.groupBy(F.trunc("o_orderdate", "month").alias("as_of"), F.col("o_custkey").alias("security_id")).agg(F.sum("o_totalprice").alias("signal"))
    return s.join(c.select(F.col("c_custkey").alias("security_id"), F.col("c_mktsegment").alias("industry"), F.greatest(F.col("c_acctbal"), F.lit(1.0)).alias("cap")), "security_id")


SIGNALS = """sg AS (SELECT s.as_of, s.security_id, s.signal, c.c_mktsegment AS industry, greatest(c.c_acctbal, 1.0) AS cap
 FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS as_of, o_custkey AS security_id, SUM(o_totalprice) AS signal FROM orders GROUP BY 1, 2) s
 JOIN customer c ON c.c_custkey = s.security_id)"""


def membership(spark: SparkSession, d: str) -> DataFrame:
    """Index membership intervals from orders: index_id, security_id, from_date, to_date, weight."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority", "o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("index_id"), F.col("o_custkey").alias("security_id"), F.to_date("o_orderdate").alias("from_date"), F.to_date(F.lead("o_orderdate").over(w)).alias("to_date"), F.col("o_totalprice").alias("weight")
    )


MEMBERSHIP = """mb AS (SELECT o_orderpriority AS index_id, o_custkey AS security_id, CAST(o_orderdate AS DATE) AS from_date,
 CAST(LEAD(o_orderdate) OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS to_date, o_totalprice AS weight FROM orders)"""
