"""Wave planning, gates and the course of a staged rollout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.health import failure_rate
from tidemark.staging import staged

# First wave and its versions, the second wave's size, the gate, tries, labels.
FIRST_WAVE, VERSIONS, SECOND_WAVE, GATE = 5, (8, 9, 10, 11), 20, 0.02
MOST_TRIES = 4
LABELS = {"pending": "pending", "in_progress": "in progress", "succeeded": "succeeded", "failed": "failed", "interrupted": "interrupted (connection lost)", "rolled_back": "rolled back"}

#: Bits of a row's number within its partition, as Spark lays out its increasing ids.
_ROW_BITS = 33


def label(status: Column) -> Column:
    """The words shown for a status; null for an unknown one."""
    shown = F.lit(None).cast("string")
    for s, words in LABELS.items():
        shown = F.when(status == s, words).otherwise(shown)
    return shown


def eligible(devices: DataFrame) -> DataFrame:
    return devices.where(~F.col("connection").isin("offline", "flaky") & F.col("task").isNull())


def _numbered(df: DataFrame, order: str, out: str) -> DataFrame:
    """Global row numbers from 1 without gathering the rows.

    Rows are range-partitioned, sorted within partitions and staged with their number
    there; a partition's rows are shifted by the sizes of the partitions before, found by
    an equi join on the partition's number.  Only one row a partition meets in one task.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id())
    frozen = staged(ranged, "numbered").withColumn("part", F.shiftright("at", _ROW_BITS))
    sizes = frozen.groupBy("part").agg(F.count("*").alias("size"))
    shift = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    nth = F.col("shift") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return frozen.join(shift, "part").withColumn(out, nth).drop("part", "at", "shift")


def plan(devices: DataFrame) -> DataFrame:
    """device_id, wave: one device of each version and one more, then 20, 40, 80, ... in id order.

    Without an eligible device of every version the plan is empty.
    """
    ok = eligible(devices).select("device_id", "version")
    firsts = {r["version"]: r["device_id"] for r in ok.where(F.col("version").isin(*VERSIONS)).groupBy("version").agg(F.min("device_id").alias("device_id")).collect()}  # a row a version
    if len(firsts) < len(VERSIONS):
        return ok.select("device_id", F.lit(1).cast("long").alias("wave")).limit(0)
    lead = F.col("device_id").isin(*firsts.values())
    rest = _numbered(ok.where(~lead).select("device_id"), "device_id", "r")
    # waves of 20 * 2 ** k end at 20 * (2 ** (k + 1) - 1): the wave is the bit length
    nth = F.col("r") - (FIRST_WAVE - len(VERSIONS))
    wave = F.when(nth <= 0, 1).otherwise(F.length(F.bin(F.floor((nth - 1) / SECOND_WAVE) + 1)) + 1)
    return rest.select("device_id", wave.cast("long").alias("wave")).unionByName(ok.where(lead).select("device_id", F.lit(1).cast("long").alias("wave")))


def gates(records: DataFrame) -> DataFrame:
    """Failure rate of each wave and whether the rollout halts there."""
    rates = records.groupBy("wave").agg(failure_rate(F.col("status")).alias("failure_rate"), F.bool_or(F.col("status") == "failed").alias("any_failed"))
    halt = F.when(F.col("wave") == 1, F.col("any_failed")).otherwise(F.col("failure_rate") > GATE)
    return rates.select("wave", "failure_rate", halt.alias("halts"))


def course(planned: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rollout wave by wave: (records, waves).

    planned: device_id, wave.  outcomes: device_id, status, has_snapshot, restored_ok, as
    recorded or simulated for each device.  Waves run in order until a gate halts: that wave
    has failed and is rolled back, those before are completed, those after are halted and
    have no records.  A planned device without an outcome stays pending.
    waves: wave, status, failure_rate (as the gate saw it).
    """
    rows = planned.join(outcomes, "device_id", "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    seen = gates(rows)
    # one task, but one row a wave: their number grows with the logarithm of the devices
    stop = F.min(F.when(F.col("halts"), F.col("wave"))).over(W.orderBy("wave").rowsBetween(W.unboundedPreceding, 0))
    state = F.when(F.col("stop").isNull(), "completed").when(F.col("wave") == F.col("stop"), "failed").otherwise("halted")
    waves = seen.withColumn("stop", stop).withColumn("wave_status", state)
    waves = waves.select("wave", "wave_status", F.when(F.col("wave_status") != "halted", F.col("failure_rate")).alias("failure_rate"))
    run = rows.join(waves.select("wave", "wave_status"), "wave").where("wave_status <> 'halted'")
    back = rolled_back(run.where("wave_status = 'failed'"))
    records = run.where("wave_status = 'completed'").withColumn("error", F.lit(None).cast("string")).unionByName(back)
    return records.select("device_id", "wave", "status", "error"), waves.withColumnRenamed("wave_status", "status")


def histogram(records: DataFrame) -> DataFrame:
    return records.agg(*[F.count_if(F.col("status") == s).alias(s) for s in LABELS])


def outcome(attempts: DataFrame, most: int = MOST_TRIES) -> DataFrame:
    """The first try among ``most`` that kept its connection decides; interrupted where none did."""
    kept = F.col("result") != "disconnected"
    tries = attempts.where(F.col("attempt") <= most).groupBy("device_id").agg(F.min_by("result", F.when(kept, F.col("attempt"))).alias("first"))
    return tries.select("device_id", F.coalesce("first", F.lit("interrupted")).alias("status"))


def rolled_back(records: DataFrame) -> DataFrame:
    """What a rollback leaves, and the error of one that didn't work.

    Succeeded and failed devices are touched.  One with a snapshot that restores and passes
    the check again is rolled_back; else its status stays and ``error`` says why.
    """
    hit = F.col("status").isin("succeeded", "failed")
    snapshot, restored = F.coalesce("has_snapshot", F.lit(False)), F.coalesce("restored_ok", F.lit(False))
    error = F.when(hit & ~snapshot, "rollback: no snapshot").when(hit & ~restored, "rollback: not restored")
    rows = records.withColumn("error", error)
    return rows.withColumn("status", F.when(hit & F.col("error").isNull(), "rolled_back").otherwise(F.col("status")))
