"""Positions and running sums over an order, without one task for a large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.sizing import stage


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """Adds nth, a row's number from 0 within its ``by`` group, and before_x, the sum of each x of the rows before it.

    ``order`` should tell all rows of a group apart.  Rows are range-partitioned by group
    and order, so a large group is spread over many partitions, and staged with their
    partition; rows are numbered within partitions and shifted by what the partitions
    before hold of the group, which is one row a partition and group.  The frame's plan
    runs twice (its ranges are sampled).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frozen = stage(df.repartitionByRange(parts, *by, *order).withColumn("part", F.spark_partition_id()), name)
    here = W.partitionBy("part", *by).orderBy(*order)
    earlier = here.rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    rows = frozen.withColumn("nth", F.row_number().over(here).cast("long") - 1)
    for x in sums:
        rows = rows.withColumn(f"before_{x}", F.coalesce(F.sum(x).over(earlier), none))
    held = frozen.groupBy("part", *by).agg(F.count("*").alias("rows"), *[F.sum(x).alias(f"of_{x}") for x in sums])
    parts_before = W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = held.select("part", *by, *[F.coalesce(F.sum(c).over(parts_before), none).alias(f"shift_{c}") for c in ("rows", *(f"of_{x}" for x in sums))])
    both = rows.join(shift, ["part", *by])
    both = both.withColumn("nth", F.col("nth") + F.col("shift_rows"))
    for x in sums:
        both = both.withColumn(f"before_{x}", F.col(f"before_{x}") + F.col(f"shift_of_{x}"))
    return both.drop("part", "shift_rows", *[f"shift_of_{x}" for x in sums])


#: Keys that hold more than this part of a frame's rows are joined by broadcast; there can't be more of them.
MOST_HOT = 10_000


def hot_join(left: DataFrame, right: DataFrame, on: list[str], times: str, total: int) -> DataFrame:
    """Inner join where a key may hold a large share of the left rows.

    right has each key once, and in ``times`` how many left rows have it; total is at least
    the left's number of rows.  Keys of more than total / MOST_HOT rows, so MOST_HOT at most,
    are broadcast and their rows stay where they are; all others are joined as usual.  The
    left frame is read twice and should be staged.
    """
    hot = F.col(times) > max(1, total // MOST_HOT)
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti")
    return left.join(few, on).unionByName(rest.join(right.where(~hot), on))
