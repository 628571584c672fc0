"""Spark session for local runs, tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings every query here assumes (UTC, AQE)."""
    n = shuffle_partitions or (8 if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wavemill")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
