"""Queries p7 to p9 over the whole documents table. None of them has an SQL twin but by its tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .mixing import mix
from .packing import pack
from .residue import residue
from .tokens import n_tokens, tokens_and_quality


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = {r["pack_name"]: r["capacity_tokens"] for r in table(spark, d, "pack_sizes").collect()}
    return pack(table(spark, d, "documents").select("doc_id", n_tokens(F.col("text")).alias("n_tokens")), sizes)


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its container."""
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their tokens and how full they are, by container size."""
    c = _packed(spark, d).groupBy("container_id", "pack_name", "capacity").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return c.groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") / F.sum(F.col("capacity").cast("long")), 6).alias("fill"), F.max("tokens").alias("fullest")
    )


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "source", tokens_and_quality(F.col("text")).alias("m")).select("doc_id", "source", F.col("m.n").alias("n_tokens"), "m.quality")
    return mix(docs, table(spark, d, "mix_targets"), weight="quality")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents with their number of uses."""
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share every source reached."""
    return _mixed(spark, d)[1]


def p9_lines(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their line counts, evidence counts and verdict."""
    return residue(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents"), only_suspects=True).where("is_residue").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p7_pack, p7_fill, p8_mix, p8_shares, p9_lines, p9_found)}
SQL: dict[str, str] = {}
