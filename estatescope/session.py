"""Session defaults.  Cluster sizing belongs to spark-submit; only what the plans
rely on is set here, and only where the caller has not set it."""

from __future__ import annotations

from pyspark.sql import SparkSession

PLAN_DEFAULTS = {
    # Joins are never hinted: Spark broadcasts a side whose size (by its files, or measured) is
    # below its threshold, and AQE splits skewed partitions of the others.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the join's partitioning would have been reused.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    # Text work is CPU-bound: split files into smaller tasks than the default.
    "spark.sql.files.maxPartitionBytes": "32m",
    # Every column call would otherwise record its Python stack, which for plans of this
    # size costs more than planning them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "estatescope",
                  **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**PLAN_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
