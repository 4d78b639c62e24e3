"""Intermediate tables in the folder that a cluster's executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def staged_by(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """As ``staged``, written in hash buckets of ``key``: what groups or joins by the key moves nothing.

    The catalog only serves to read the buckets back; the entry is dropped at once, its files stay.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    table = f"staged_{mark}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_folder(spark)}/{name}-{mark}").option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"drop table {table}")
    return out


_made: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The application's own folder below ``spark.checkpoint.dir``, deleted when its driver ends.

    Where that setting is lacking, a local session (one machine, so its folders are shared)
    uses the warehouse folder; a cluster must name a folder.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged"
    folder = f"{folder.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if folder not in _made:
        _made.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def _delete(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
