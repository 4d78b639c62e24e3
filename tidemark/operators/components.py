"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import staged as stage

MOST_ROUNDS = 60


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for every id on an edge (a, b); root is the smallest id it reaches.

    Each round is three hash aggregations and joins over the edges that are left, and
    is written to the shared folder.  Minima are pre-aggregated; a node with very many
    edges only skews a join on one side, which adaptive execution splits.
    """
    e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u < v").distinct()
    e = stage(e, name)
    before = _mark(e)
    for _ in range(MOST_ROUNDS):
        e = stage(_small_star(_large_star(e)), name)
        now = _mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("id"), F.col("u").alias("root")).distinct()
    return e.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(roots)


def _mark(e: DataFrame):
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    far = both.where("v > u").join(least, "u")
    return far.select("v", F.col("m").alias("u")).where("u < v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """e: (v, u) with u < v. Every v and its smaller neighbours hang on the least of them."""
    least = e.groupBy("v").agg(F.min("u").alias("m"))
    near = e.join(least, "v")
    hung = near.select(F.col("u").alias("v"), F.col("m").alias("u"))
    own = least.select("v", F.col("m").alias("u"))
    return hung.union(own).where("u < v").distinct()
