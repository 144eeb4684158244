"""Spark session with the settings that the plans assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "feedloom", master: str | None = None, shuffle_partitions: int | None = None, extra: dict[str, str] | None = None) -> SparkSession:
    """UTC, adaptive execution with skew-join splitting; sizes are left to the cluster's own settings unless given."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = b.config(map=conf | (extra or {})).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
