"""A session with the settings that the engine expects; a session made elsewhere works as well."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", **more: str) -> SparkSession:
    """UTC, adaptive execution with skewed joins split, and nothing tied to one machine's size."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | more
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
