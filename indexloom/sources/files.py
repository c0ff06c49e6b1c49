"""Delimited and JSON sources, and their reshaping into canonical tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = True) -> DataFrame:
    """CSV or TSV with a declared schema; nothing is inferred. Malformed rows become nulls."""
    return spark.read.schema(schema).csv(path, sep=sep, header=header, mode="PERMISSIVE")


def read_after_preamble(spark: SparkSession, path: str, marker: str, sep: str = ",") -> DataFrame:
    """CSV files with lines before their header: the header is the first line that starts with ``marker``.

    Files are read as text with their line numbers kept by the file's own order (one file, one
    partition of lines); column names are normalised to lower case with underscores.
    """
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    arr = lines.select(F.expr(f"slice(l, greatest(1, array_position(transform(l, x -> startswith(x, '{marker}')), true)), size(l))").alias("l"))
    head = [h.strip().strip('"').lower().replace(" ", "_") for h in arr.select(F.col("l")[0]).first()[0].split(sep)]
    rows = arr.select(F.explode(F.slice("l", 2, F.size("l"))).alias("r")).where(F.length(F.trim("r")) > 0)
    parsed = F.from_csv("r", ", ".join(f"`{h}` string" for h in head), {"sep": sep, "quote": '"'})
    return rows.select(parsed.alias("p")).select("p.*")


def number(c: str):
    """A number with thousands separators; null if it is none."""
    return F.expr(f"try_cast(replace(`{c}`, ',', '') AS double)")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifests(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A folder of whole-file JSON documents, one row each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def to_long(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide columns to rows, nulls left out."""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Columns renamed after normalising their names, and only the wanted ones kept."""
    low = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    return df.select(*[F.col(f"`{low[a]}`").alias(b) for a, b in names.items() if a in low])
