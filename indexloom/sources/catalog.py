"""A catalog of temp views over a snapshot: named frames, parameterised SQL, row counts, provider routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshot import REQUIRED, Snapshot


class Catalog:
    """Views are lazy: registering reads nothing, and predicates of later SQL reach the files."""

    def __init__(self, spark: SparkSession, prefix: str = ""):
        self.spark, self.prefix, self.names = spark, prefix, []

    def register(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self.prefix + name)
        if name not in self.names:
            self.names.append(name)

    def load(self, snapshot: Snapshot, tables: list[str] = REQUIRED) -> Catalog:
        for t in tables:
            self.register(t, snapshot.table(t))
        return self

    def sql(self, query: str, **args: object) -> DataFrame:
        """SQL with named parameters (``:name``)."""
        return self.spark.sql(query, args=args or None)

    def tables(self) -> list[str]:
        return sorted(self.names)

    def row_counts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.table(self.prefix + t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in self.names])


def write_cookbook(patterns: Mapping[str, str], path: str) -> None:
    """A Markdown file with one section per named SQL pattern."""
    Path(path).write_text("\n\n".join(["# SQL patterns", *[f"## {n}\n\n```sql\n{q.strip()}\n```" for n, q in sorted(patterns.items())]]) + "\n")


class Router:
    """Sends each read method to one of several providers."""

    def __init__(self, providers: Mapping[str, object], routes: Mapping[str, str]):
        self.providers, self.routes = dict(providers), dict(routes)

    def route(self, method: str) -> str:
        if method not in self.routes:
            raise KeyError(f"no provider serves {method}")
        return self.routes[method]

    def __getattr__(self, method: str) -> Callable:
        return getattr(self.providers[self.route(method)], method)

    def capabilities(self, spark: SparkSession, methods: list[str]) -> DataFrame:
        """Provider by method: yes, routed (yes and chosen) or absent."""
        rows = [(n, m, "routed" if self.routes.get(m) == n else "yes" if hasattr(p, m) else "absent") for n, p in self.providers.items() for m in methods]
        return spark.createDataFrame(rows, "provider string, method string, support string").groupBy("provider").pivot("method", methods).agg(F.first("support"))
