"""Event-time windows over a file stream, and their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream with a declared schema."""
    kind = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", name).parquet(folder)


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums per event type and tumbling or sliding window; events later than ``late`` are dropped by the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return e.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns its last result, kept in the shared folder."""
    spark = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{at}/out")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Sessions per key: start, end of the last event, events, total."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(key, F.col("session_window.start").alias("start"), "last", "n", "total")
