"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def session(master: str | None = None, app: str = "lectern", **conf: str) -> SparkSession:
    """master and anything else may be given by spark-submit instead."""
    builder = SparkSession.builder.appName(app).config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()
