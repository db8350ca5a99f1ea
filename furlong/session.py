"""The session every query runs in: UTC, adaptive execution, Arrow transfer."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "furlong", master: str | None = None, **conf: str) -> SparkSession:
    """Return the running session or start one. ``conf`` entries override the defaults below."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" in os.environ:
        builder = builder.master(master or os.environ["SPARK_MASTER"])
    return builder.config(map=settings).getOrCreate()
