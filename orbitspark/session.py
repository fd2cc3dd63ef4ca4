"""Session with the settings that results depend on: UTC, ANSI arithmetic, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "orbitspark", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in settings.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
