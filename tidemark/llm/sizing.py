"""Input sizes from plan statistics, samples that don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import staged as stage  # noqa: F401

#: Statistics above this are Spark's "unknown" default, not a measurement.
UNKNOWN_BYTES = 1 << 55
#: Text bytes per byte of column-compressed input, for sizing only.
TEXT_PER_INPUT_BYTE = 2


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """About how many bytes of text a frame holds; only decides how many pieces to cut.

    Scans answer from file sizes without a job.  A frame whose plan has no such
    statistics (for instance one read back from a checkpoint) is summed instead.
    """
    guess = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if guess < UNKNOWN_BYTES and not df.isLocal():
        return guess * TEXT_PER_INPUT_BYTE
    return int(df.agg(F.sum(F.octet_length(column)).alias("b")).first().b or 0)


def pieces(total: int, each: int, least: int = 16, most: int = 1 << 30) -> int:
    """How many pieces of about ``each`` bytes; ``most`` keeps their numbers within an int."""
    return max(least, min(most, total // each + 1))


def hashed_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows whose key has the least hash; the same rows however the frame is partitioned.

    ``key`` should not repeat.  A top-k: every partition keeps ``most`` rows at most.
    """
    return df.orderBy(F.xxhash64(key), key).limit(most)
