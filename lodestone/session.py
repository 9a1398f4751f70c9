"""Spark session with the settings that results depend on, and defaults for one machine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. Without ``master`` the cluster's own
    settings hold; ``shuffle`` sets the number of shuffle partitions."""
    builder = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()
