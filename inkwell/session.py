"""A session with the settings that results depend on."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[1])


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it is not installed but lies on a common path."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)
    return spark


def session(name: str = "inkwell", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, so that dates and texts of dates do not depend on the machine; adaptive plans; any further settings by name."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", **conf}
    return prepare(builder.config(map=settings).getOrCreate())
