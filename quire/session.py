"""A Spark session with the settings that the library's results rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quire", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans and Arrow on; ``conf`` keys use _ for the dot."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in {**fixed, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
