"""Session defaults shared by the tests, the benchmark and interactive use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tideline", master: str | None = None, shuffle_partitions: int = 8, **conf) -> SparkSession:
    """A local session with UTC time, adaptive execution and no console noise; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("TIDELINE_DRIVER_MEMORY", "8g"),
    } | {k.replace("__", "."): str(v) for k, v in conf.items()}
    builder = SparkSession.builder.appName(app).master(master or f"local[{os.environ.get('BENCH_CPUS', '8')}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
