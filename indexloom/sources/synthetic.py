"""A deterministic synthetic universe of any size, generated in parallel from hashes of the keys.

Nothing is drawn on the driver and no random stream is shared: every value depends on (seed, key)
only, so the same configuration gives the same tables on any cluster.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import business_days
from ..functions.identifiers import make_isin, make_sedol


@dataclass(frozen=True)
class Config:
    securities: int = 500
    start: str = "2016-01-04"
    end: str = "2018-12-31"
    seed: int = 7
    volatility: float = 0.015

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


COUNTRIES = [("US", "USD"), ("GB", "GBP"), ("DE", "EUR"), ("JP", "JPY"), ("CA", "CAD")]
HOLIDAYS = ["01-01", "05-01", "07-04", "12-25", "12-26", "12-31"]


class Universe:
    def __init__(self, spark: SparkSession, config: Config | None = None):
        self.spark, self.config = spark, config or Config()

    def _unit(self, *keys: Column | str, salt: int) -> Column:
        """A number in (0, 1) from the seed, the salt and the keys."""
        return (F.shiftrightunsigned(F.xxhash64(F.lit(self.config.seed), F.lit(salt), *keys), 12) + 0.5) / float(1 << 52)

    def _normal(self, *keys: Column | str, salt: int) -> Column:
        """Box-Muller from two such numbers."""
        return F.sqrt(-2 * F.log(self._unit(*keys, salt=salt))) * F.cos(2 * 3.141592653589793 * self._unit(*keys, salt=salt + 1))

    def calendar(self) -> DataFrame:
        c = self.config
        return self.spark.range(1).select(F.explode(business_days(c.start, c.end, HOLIDAYS)).alias("date"))

    def securities(self) -> DataFrame:
        pick = F.floor(self._unit("id", salt=1) * len(COUNTRIES)).cast("int")
        at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in COUNTRIES]), pick + 1)
        sid = F.format_string("S%07d", F.col("id"))
        return self.spark.range(self.config.securities).select(
            sid.alias("security_id"), F.format_string("I%07d", F.floor(F.col("id") * 0.97)).alias("issuer_id"), at(0).alias("country"), at(1).alias("currency"), (F.floor(self._unit("id", salt=2) * 11) * 5 + 10).cast("string").alias("icb_industry"), F.lit(self.config.start).cast("date").alias("listing_start")
        )

    def identifiers(self) -> DataFrame:
        n = F.substring("security_id", 2, 7).cast("int")
        return self.securities().select("security_id", make_isin(F.col("country"), n).alias("isin"), make_sedol(n).alias("sedol"), F.concat(F.lit("T"), n.cast("string")).alias("ticker"), F.col("listing_start").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))

    def prices(self) -> DataFrame:
        """Log-normal closes: a running sum of hashed normal steps per security, volumes and rare suspensions."""
        x = self._grid()
        step = self._normal("security_id", "date", salt=10) * self.config.volatility
        w = Window.partitionBy("security_id").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        x = x.withColumn("__l", F.log(20 + 80 * self._unit("security_id", salt=20)) + F.sum(step).over(w))
        volume = F.round(F.exp(11 + self._normal("security_id", "date", salt=30)))
        return x.select("security_id", F.col("security_id").alias("listing_id"), "date", F.round(F.exp("__l"), 3).alias("close"), volume.alias("volume"), (self._unit("security_id", "date", salt=40) < 0.001).alias("is_suspended"))

    def _grid(self) -> DataFrame:
        """Every security on every day: each row explodes its own calendar, nothing is joined."""
        c = self.config
        return self.securities().select("security_id", F.explode(business_days(c.start, c.end, HOLIDAYS)).alias("date"))

    def materialise(self, path: str) -> None:
        for name in ("securities", "identifiers", "prices"):
            getattr(self, name)().write.mode("overwrite").parquet(f"{path}/{name}.parquet")
