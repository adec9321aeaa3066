"""Session settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandline", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC times.

    Shuffle width is left to adaptive coalescing on a cluster: start wide, merge small
    partitions. Checkpoint files of tables no longer in use are removed. Pass settings with dots written as double underscores.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {name.replace("__", "."): str(value) for name, value in conf.items()}
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
