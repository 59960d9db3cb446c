"""Session defaults for graph work; everything also runs on a session made elsewhere."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "graphloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; keyword arguments are settings with _ for the dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()
