"""A session with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(app: str = "scriptorium", **conf: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, Arrow; keyword arguments, with _ for ., override."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
