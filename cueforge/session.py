"""Session helpers: one for tests, benches and scripts, and one for steps with settings of their own; operators take the caller's session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cpus: int | None = None, partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("cueforge")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def session_with(spark: SparkSession, **settings: str) -> SparkSession:
    """A session beside spark with its settings but for those given (dots as __): what runs in spark meanwhile is not touched."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key.replace("__", "."), value)
    return own
