"""A session with the settings that these programs expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "sparkloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive plans with skew joins and coalescing; anything else comes from the caller or the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
