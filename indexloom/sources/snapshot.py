"""A snapshot: a folder of the canonical tables, with the providers' read methods as lazy frames."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pit
from .tables import table

REQUIRED = ["prices", "shares", "fundamentals", "corp_actions", "securities", "listings", "identifiers"]


class Snapshot:
    """Reads tables of one folder. Missing required tables are an error at opening, never an empty result."""

    def __init__(self, spark: SparkSession, path: str, required: Sequence[str] = REQUIRED):
        self.spark, self.path = spark, path
        if "://" not in path:
            missing = [t for t in required if not Path(path, f"{t}.parquet").exists()]
            if missing:
                raise FileNotFoundError(f"{path} lacks {', '.join(missing)}")

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.path, name)

    def calendar(self) -> DataFrame:
        return self.table("prices").select("date").where("date IS NOT NULL").distinct()

    def prices(self, listing_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        return self._scan("prices", "listing_id", listing_ids, "date", start, end)

    def shares_history(self, security_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        return self._scan("shares", "security_id", security_ids, "effective_date", start, end)

    def corp_actions(self, security_ids: Sequence[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        return self._scan("corp_actions", "security_id", security_ids, "ex_date", start, end)

    def _scan(self, name: str, key: str, ids: Sequence[str] | None, day: str, start: str | None, end: str | None) -> DataFrame:
        df = self.table(name)
        if ids is not None:
            df = df.where(F.col(key).isin(*ids))
        if start is not None:
            df = df.where(F.col(day) >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col(day) <= F.lit(end).cast("date"))
        return df

    def shares(self, as_of: str) -> DataFrame:
        """The latest row per security known on the day, by effective then knowledge date."""
        return pit.latest_by(pit.known_at(self.table("shares"), as_of, "knowledge_date"), ["security_id"], ["effective_date", "knowledge_date", "shares_outstanding", "free_float_factor"], ["effective_date", "knowledge_date", "shares_outstanding", "free_float_factor"])

    def fundamentals(self, as_of: str, items: Sequence[str], max_staleness_days: int = 550) -> DataFrame:
        return pit.pit_latest(self.table("fundamentals"), as_of, items, max_staleness_days)

    def fundamentals_ttm(self, as_of: str, item: str) -> DataFrame:
        return pit.trailing_sum(self.table("fundamentals"), as_of, item)

    def classifications(self) -> DataFrame:
        """From securities: industry, and the industry's first supersector."""
        return self.table("securities").select("security_id", "icb_industry", F.concat("icb_industry", F.lit("10")).alias("icb_supersector"))

    def issuers(self) -> DataFrame:
        """The first security's attributes per issuer."""
        s = self.table("securities").groupBy("issuer_id").agg(F.min(F.struct("security_id", "country", "currency")).alias("s"))
        return s.select("issuer_id", "s.security_id", "s.country", "s.currency")

    def summary(self) -> DataFrame:
        """Row counts of all tables and events by type: (what, n)."""
        n = [self.table(t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("what"), "n") for t in REQUIRED]
        e = self.table("corp_actions").groupBy(F.concat(F.lit("event:"), F.col("event_type")).alias("what")).agg(F.count(F.lit(1)).alias("n"))
        return reduce(DataFrame.unionByName, [*n, e])

    def materialise(self, path: str, tables: Sequence[str] = REQUIRED, **config: object) -> None:
        """Writes the tables to another folder, and the configuration beside them."""
        for t in tables:
            self.table(t).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        self.spark.createDataFrame([(json.dumps({**config, "tables": list(tables)}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")

    def fingerprint(self, tables: Sequence[str] = REQUIRED) -> str:
        """16 hex digits over the order-insensitive content hashes of the tables."""
        from ..operators.compare import content_hash

        parts = [f"{t}:{content_hash(self.table(t)).first()['content_hash']}" for t in sorted(tables)]
        return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def write_filed_years(fundamentals: DataFrame, path: str) -> None:
    """A store partitioned by filing year, so that a condition on the filing date prunes folders."""
    fundamentals.where("filed_date IS NOT NULL").withColumn("filed_year", F.year("filed_date")).repartition("filed_year").write.mode("overwrite").partitionBy("filed_year").parquet(path)


def read_filed_years(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """The store's rows filed by a day; the derived year condition prunes partitions."""
    return spark.read.parquet(path).where((F.col("filed_year") <= int(as_of[:4])) & (F.col("filed_date") <= F.lit(as_of).cast("date")))
