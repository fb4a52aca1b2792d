"""Session settings the engine is written for; every value can be overridden by the caller."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that submit made."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("hyperloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", memory or os.environ.get("HYPERLOOM_MEMORY", "8g"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
