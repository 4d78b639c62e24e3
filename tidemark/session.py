"""A session with the settings that the queries assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle: int = 8, **more: str) -> SparkSession:
    conf = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": str(shuffle), "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(master).config(map=conf | {k.replace("_", "."): v for k, v in more.items()}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
