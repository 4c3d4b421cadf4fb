"""The session settings that the library's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "wordloom", **conf: str) -> SparkSession:
    """A session with adaptive execution (coalescing, skew splitting) and UTC; the cluster's own settings stay where they are given."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
