"""A made device fleet: the same numbers and seed give the same devices anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Shares of devices, in thousandths, and the versions.
OFFLINE, FLAKY, BUSY = 50, 100, 80
VERSIONS = (8, 9, 10, 11)


def draw(seed: int, what: str, number: Column, below: int) -> Column:
    """A number from 0 to below - 1, by a hash of seed, purpose and device."""
    text = F.concat(F.lit(f"{seed}:{what}:"), number.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(below))


def fleet(spark: SparkSession, count: int = 200, as_of: str = "2025-01-01 00:00:00", seed: int = 1) -> DataFrame:
    """Devices 1 to ``count``; see ``devices``."""
    return devices(spark.range(1, count + 1), as_of, seed)


def devices(numbers: DataFrame, as_of: str = "2025-01-01 00:00:00", seed: int = 1) -> DataFrame:
    """device_id, version, task, connection, last_heartbeat of each device of a table of numbers (id, from 1).

    The first four devices are idle, connected, and cover the versions.
    """
    n = F.col("id")
    rows = numbers
    roll = draw(seed, "connection", n, 1000)
    forced = n <= len(VERSIONS)
    connection = F.when(forced, "good").when(roll < OFFLINE, "offline").when(roll < OFFLINE + FLAKY, "flaky").otherwise("good")
    busy = ~forced & (roll >= OFFLINE + FLAKY) & (draw(seed, "busy", n, 1000) < BUSY)
    version = F.when(forced, n + VERSIONS[0] - 1).otherwise(draw(seed, "version", n, len(VERSIONS)) + VERSIONS[0])
    beat = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=draw(seed, "heartbeat", n, 301))
    width = F.greatest(F.lit(3), F.length(n.cast("string")))
    return rows.select(
        F.concat(F.lit("device-"), F.lpad(n.cast("string"), width, "0")).alias("device_id"), version.cast("long").alias("version"),
        F.when(busy, F.concat(F.lit("task-"), (draw(seed, "task", n, 9000) + 1000).cast("string"))).alias("task"), connection.alias("connection"), beat.alias("last_heartbeat"),
    )
