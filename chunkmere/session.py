"""Session settings for the engine; all of them hold on a cluster as on one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, app: str = "chunkmere", **settings: str) -> SparkSession:
    """A session with SETTINGS; ``settings`` (dots as underscores twice) come on top."""
    made = SparkSession.builder.appName(app)
    if master:
        made = made.master(master)
    for k, v in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        made = made.config(k, v)
    return made.getOrCreate()
