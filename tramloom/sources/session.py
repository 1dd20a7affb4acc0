"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tramloom", cores: int | str = "*", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer; existing settings of a cluster are kept."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if SparkSession.getActiveSession() is None and "spark.master" not in conf:
        builder = builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
