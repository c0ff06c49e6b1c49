"""A lambda view kept in a shared folder: arriving increments, scheduled batches, frozen periods.

``log/N`` holds the records of increment N as they came. ``speed/N`` holds its small table of
partial states with the last day any of them became known: the fast layer. ``batch/N`` holds the
state of every period as batch N left it, frozen ones included, and which increments it covers.
Increments and batches are numbered apart, an increment of a stream by its batch id, so that a
replayed micro-batch overwrites itself and an ingest beside a batch takes no number from it. Every
write is published by creating a marker file after it; unpublished folders are never read, so a
lost executor or driver leaves the last published state readable.

An increment stays in the fast layer until a batch has *covered* it: all its records were known by
the batch's day and it was published before the batch began. What a batch left out of its figures
(records known after its day) is therefore still served.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.late import late_by, state, usable


class LambdaStore:
    def __init__(self, spark: SparkSession, path: str, *, entity: Sequence[str], event_time: str, known_time: str, value: str, schema: str, lateness_days: int = 45):
        self.spark, self.path, self.schema, self.lateness = spark, path.rstrip("/"), schema, lateness_days
        self.columns = dict(entity=list(entity), event_time=event_time, known_time=known_time, value=value)
        self.keys = [f"e{i}" for i in range(len(entity))]
        fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs, self._p = fs, spark._jvm.org.apache.hadoop.fs.Path

    # -- layers

    def ingest(self, increment: DataFrame, number: int | None = None) -> None:
        """Fast layer: stores the increment and folds it to one partial state per period. The same ``number`` replaces, it does not add."""
        n = max(self._published("speed"), default=0) + 1 if number is None else number
        increment.write.mode("overwrite").parquet(f"{self.path}/log/{n}")
        u = usable(self._log([n]), **self.columns)
        u.where(late_by() <= self.lateness).groupBy(*self.keys, "p").agg(state().alias("s"), F.max("k").alias("known")).write.mode("overwrite").parquet(f"{self.path}/speed/{n}")
        self._publish("speed", n)

    def run_batch(self, as_of: dt.date) -> None:
        """Recomputes the open periods from the full log as known on the day, replaces them, and freezes those past the cut-off."""
        parts = self._published("speed")
        if not parts:
            return
        n = max(self._published("batch"), default=0) + 1
        day = F.lit(as_of.isoformat()).cast("date")
        past = F.date_add(F.last_day("p"), self.lateness) < day
        log = usable(self._log(parts), **self.columns).where((F.col("k") <= day) & (late_by() <= self.lateness))
        before = self._batch()
        frozen = before.where("frozen") if before is not None else None
        if frozen is not None:
            log = log.join(frozen.select(*self.keys, "p"), [*self.keys, "p"], "left_anti")
        new = log.groupBy(*self.keys, "p").agg(state().alias("s")).withColumn("frozen", past)
        (new if frozen is None else new.unionByName(frozen)).write.mode("overwrite").parquet(f"{self.path}/batch/{n}")
        latest = self._speed(parts).groupBy("number").agg(F.max("known").alias("known")).where(F.col("known") > day)
        ahead = {r["number"] for r in latest.collect()}  # numbers of increments only
        self.spark.createDataFrame([(i,) for i in parts if i not in ahead], "number bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/covered/{n}")
        self._publish("batch", n)

    def serve(self) -> DataFrame:
        """The view now: entity, period, value, frozen. Frozen periods ignore increments; open ones merge them."""
        batch, parts = self._batch(), self._published("speed")
        if batch is not None:
            done = {r["number"] for r in self.spark.read.parquet(f"{self.path}/covered/{max(self._published('batch'))}").collect()}
            parts = [i for i in parts if i not in done]
        speed = self._speed(parts).select(*self.keys, "p", "s", F.lit(False).alias("frozen")) if parts else None
        x = batch.unionByName(speed) if batch is not None and speed is not None else batch if speed is None else speed
        if x is None:
            raise FileNotFoundError(f"{self.path} holds no view yet")
        done = F.max(F.when(F.col("frozen"), F.col("s")))
        g = x.groupBy(*self.keys, "p").agg(done.alias("done"), F.max("s").alias("s"), F.max("frozen").alias("frozen"))
        names = self.columns["entity"]
        return g.select(*[F.col(k).alias(c) for k, c in zip(self.keys, names, strict=True)], F.col("p").alias("period"), F.coalesce("done", "s")["v"].alias("value"), "frozen")

    def attach(self, stream: DataFrame, checkpoint: str, **trigger):
        """Feeds a streaming frame to the fast layer, one increment per micro-batch, numbered by its batch id."""
        return stream.writeStream.foreachBatch(lambda df, i: self.ingest(df, number=i + 1)).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    # -- storage

    def _log(self, numbers: Sequence[int]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/log/{i}" for i in numbers])

    def _speed(self, numbers: Sequence[int]) -> DataFrame:
        x = self.spark.read.parquet(*[f"{self.path}/speed/{i}" for i in numbers])
        return x.withColumn("number", F.regexp_extract(F.col("_metadata.file_path"), r"/speed/(\d+)/", 1).cast("bigint"))

    def _batch(self) -> DataFrame | None:
        done = self._published("batch")
        return self.spark.read.parquet(f"{self.path}/batch/{max(done)}") if done else None

    def _published(self, kind: str) -> list[int]:
        """Numbers of the published increments or batches, from the names of their marker files."""
        folder = self._p(f"{self.path}/published/{kind}")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def _publish(self, kind: str, number: int) -> None:
        at = self._p(f"{self.path}/published/{kind}/{number}")
        self._fs.mkdirs(at.getParent())
        self._fs.create(at, True).close()
