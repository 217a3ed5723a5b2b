"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks: UTC, adaptive execution, Arrow."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodestack")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
