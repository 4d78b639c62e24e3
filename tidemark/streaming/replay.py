"""A table replayed as a stream: its parts arrive one after the other, and the query is restarted for each."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemark.staging import shared_folder
from tidemark.streaming.monitor import drained


def replayed(rows: DataFrame, part: Column, parts: int, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that ``query`` of a stream of the rows appends.

    Part 0 to ``parts`` - 1 of the rows are written to the folder that the stream watches, one
    after the other; each time the query is started from its checkpoint, reads what is new and
    ends.  A run ends with a batch without data, so the rows of a part are late by the
    watermark of all parts before.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    for n in range(parts):
        rows.where(part == n).write.mode("append").parquet(f"{folder}/in")
        stream = query(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        drained(stream, f"{folder}/out", f"{folder}/checkpoint")
    try:
        return spark.read.schema(stream.schema).parquet(f"{folder}/out")
    except AnalysisException:  # nothing came out
        return spark.createDataFrame([], stream.schema)


def with_lost(closed: DataFrame, whole: DataFrame, keys: list[str], upto: Column) -> DataFrame:
    """Windows that end by ``upto`` with n, what the stream counted, and lost, what came too late.

    closed: the stream's windows; whole: the same windows over the whole table.
    """
    every = whole.where(F.col("end") <= upto).select(*keys, F.col("n").alias("total"))
    both = every.join(closed.select(*keys, "n"), keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return both.select(*keys, "n", (F.col("total") - F.col("n")).alias("lost"))
