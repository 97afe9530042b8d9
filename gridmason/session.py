"""Session defaults: adaptive execution, UTC, Arrow."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "gridmason", **conf: str) -> SparkSession:
    """A session with the engine's settings; conf overrides them (dots written as ``__``)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()
