"""Spark session defaults; on a cluster the submitted configuration wins."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, name: str = "indexloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; AQE sizes the shuffles."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": os.environ.get("LOOM_DRIVER_MEMORY", "8g")} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a local session, as in tests, gets a folder of its own where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="indexloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path
