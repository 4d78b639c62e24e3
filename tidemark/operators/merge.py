"""Two vendors' responses merged by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_rows(rows: DataFrame, key: str, ord: str, values: list[str]) -> DataFrame:
    """Last row of each key by ``ord``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*values), ord).alias("r")).select(key, "r.*")


def sides(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer join: the key once, each side's values as a struct (null where absent)."""
    x = a.select(key, F.struct(*values).alias("a"))
    y = b.select(key, F.struct(*values).alias("b"))
    return x.join(y, key, "full_outer")


def merged_max(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    return sides(a, b, key, values).select(key, *[F.greatest(f"a.{v}", f"b.{v}").alias(v) for v in values])


def merged_latest(a: DataFrame, b: DataFrame, key: str, values: list[str], fetched_a: float, fetched_b: float) -> DataFrame:
    """Whole rows of the later response, ties to a; the other's where it has none."""
    first, second = ("a", "b") if fetched_a >= fetched_b else ("b", "a")
    return sides(a, b, key, values).select(key, F.coalesce(first, second).alias("r")).select(key, "r.*")


def in_key_order(rows: DataFrame, key: str) -> DataFrame:
    """Rows sorted by key over the whole frame (a range exchange, not one task)."""
    return rows.orderBy(key)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    both = sides(a.select(key, F.lit(1).alias("one")), b.select(key, F.lit(1).alias("one")), key, ["one"])
    count = lambda c: F.count_if(c)
    return both.agg(count(F.col("b").isNull()).alias("only_in_a"), count(F.col("a").isNull()).alias("only_in_b"), count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("overlap_count"))
