"""A session with the settings that the engine's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "papertrail", **conf: str) -> SparkSession:
    """UTC and adaptive execution; the cluster's own settings, and those given, win over everything else."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
