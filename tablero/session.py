"""Session helpers: one place for the settings the plans are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str = "tablero", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A session on this machine for tests and the bench; on a cluster the submitted session is used as it is."""
    cores = cores or os.cpu_count() or 1
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
