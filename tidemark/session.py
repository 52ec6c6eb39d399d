"""Session factory: UTC, adaptive execution, RocksDB state."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes; cluster settings win where they are set."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app).master(master or f"local[{cpus}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
