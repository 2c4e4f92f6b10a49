"""Session builder with the settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "partita", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC, Arrow and ANSI; on a cluster, master and memory come from spark-submit."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()
