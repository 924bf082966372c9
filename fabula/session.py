"""A session with the settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "fabula", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, and last-wins map merging (what the JSON merge needs)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
