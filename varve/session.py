"""A session with the settings that the engine's results depend on: UTC, ANSI mode and adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "varve", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
