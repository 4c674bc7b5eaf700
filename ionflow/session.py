"""A Spark session with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "ionflow", master: str | None = None, **settings: str) -> SparkSession:
    """UTC, adaptive execution with coalescing and skew joins, Arrow; ``settings`` use underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map=base | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
