"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source gets an exact quota of words.  Its documents are dealt by a keyed
hash into permuted blocks; the quota is whole passes over all blocks plus the
first blocks of one more permutation, cut to the word inside the last of them.
A draw is one (block, pass), so the quota is a number of draws.  The draws of all
sources are divided among the output shards by halving the range of shards again and
again, each time drawing the left half's counts per source from the multivariate
hypergeometric law; the counts at the leaves are exact, so no shard can run short.
Each shard takes its count of every source's permuted draws, the next ones in turn, so
shards are disjoint, and orders what it has by a hash.  What the mix takes of a document
is what the shards have drawn of its block.

Only one row a source, and the leaves' counts, are on the driver; both are bounded by
the parameters below.  All row work is DataFrame expressions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.columns import WORD, free, fresh
from tidemark.llm.ordering import numbered
from tidemark.llm.sizing import stage
from tidemark.staging import shared_folder

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
SEED = 20_240_607
#: A block holds about this many words, or more where there would be too many blocks.
BLOCK_WORDS = 4_000
MOST_BLOCKS = 4_000_000
#: Words of a shard, or more where the tree would have more than MOST_COUNTS leaf counts (shards x sources),
#: which LEAST_SHARDS of very many sources may pass: MOST_SOURCES x LEAST_SHARDS is the bound.
SHARD_WORDS = 8_000_000
LEAST_SHARDS, MOST_COUNTS = 16, 1_000_000
MOST_SOURCES = 200_000


@dataclass(frozen=True)
class Quota:
    sid: int
    source: str | None
    weight: int
    size: int
    target: float
    blocks: int
    passes: int
    rest: int


def fill_targets(sizes: list[int], weights: list[int], total: float, most: float = MOST_REPEATS) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what is cut is shared again."""
    targets, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        level = left / sum(weights[i] for i in open_)
        full = sorted(i for i in open_ if weights[i] * level > most * sizes[i])
        if not full:
            for i in open_:
                targets[i] = weights[i] * level
            break
        for i in full:
            targets[i] = float(most * sizes[i])
            left -= targets[i]
            open_.discard(i)
    return targets


def quotas(sizes: list[tuple[str | None, int]]) -> list[Quota]:
    """Quotas by source in order of code points, null last; weights repeat in that order."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weights = [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))]
    block = max(BLOCK_WORDS, sum(n for _, n in rows) // MOST_BLOCKS)
    targets = fill_targets([n for _, n in rows], weights, SHARE * sum(n for _, n in rows))
    out = []
    for i, ((source, n), w, t) in enumerate(zip(rows, weights, targets)):
        words = min(MOST_REPEATS * n, round(t))
        blocks = max(1, n // block)
        out.append(Quota(i, source, w, n, t, blocks, words // n if n else 0, words % n if n else 0))
    return out


def shard_count(words: int, sources: int) -> int:
    return max(LEAST_SHARDS, min(words // SHARD_WORDS + 1, MOST_COUNTS // max(1, sources)))


def split_draws(draws: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Exact counts (shard, source) whose rows differ by one draw at most.

    A node's draw depends on the seed and its place in the tree alone.  The law's sampler
    takes up to 10**9 draws; MOST_BLOCKS blocks of MOST_REPEATS passes stay far below.
    """
    out = np.zeros((shards, len(draws)), dtype=np.int64)
    todo = [(0, shards, np.array(draws, dtype=np.int64), 1)]
    while todo:
        a, b, counts, node = todo.pop()
        if b - a == 1:
            out[a] = counts
            continue
        mid = (a + b) // 2
        left = int(counts.sum()) * (mid - a) // (b - a)
        live = np.flatnonzero(counts)
        part = np.zeros_like(counts)
        if len(live):
            part[live] = np.random.default_rng([seed, node % (1 << 63)]).multivariate_hypergeometric(counts[live], left, method="marginals")
        todo += [(a, mid, part, 2 * node), (mid, b, counts - part, 2 * node + 1)]
    return out


#: Rows of a table that is given as a literal.
LITERAL_ROWS = 10_000


def leaves(spark: SparkSession, draws: list[int], shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The tree's leaves as tables: (sid, step, lo, hi, shard) and (sid, width).

    A shard's draws of a source are those numbered lo to hi - 1.  Steps of ``width`` draws
    are the key that a draw finds its leaf by; about two leaves share a step.
    """
    counts = split_draws(draws, shards, seed) if draws else np.zeros((shards, 0), np.int64)
    ends = np.cumsum(counts, axis=0)
    width = [max(1, -(-n // shards)) for n in draws]
    cuts = (
        {"sid": int(s), "step": k, "lo": int(ends[h, s] - counts[h, s]), "hi": int(ends[h, s]), "shard": int(h)}
        for h, s in np.argwhere(counts)
        for k in range(int(ends[h, s] - counts[h, s]) // width[s], (int(ends[h, s]) - 1) // width[s] + 1)
    )
    schema = "sid:int,step:bigint,lo:bigint,hi:bigint,shard:int"
    # a long table is written some rows at a time, so it is no literal of every task
    part = list(islice(cuts, LITERAL_ROWS))
    table = _table(spark, part, schema)
    if len(part) == LITERAL_ROWS:
        folder = f"{shared_folder(spark)}/mix-leaves-{uuid.uuid4().hex}"
        while part:
            _table(spark, part, schema).write.mode("append").parquet(folder)
            part = list(islice(cuts, LITERAL_ROWS))
        table = spark.read.parquet(folder)
    return table, _table(spark, [{"sid": s, "width": w} for s, w in enumerate(width)], "sid:int,width:bigint")


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table as one JSON literal."""
    one = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r"))
    return one.select("r.*")


def plan(docs: DataFrame, seed: int = SEED) -> tuple[DataFrame, list[Quota]]:
    """One row for each input row: doc_id, source, sid, size, block, key; and the quotas."""
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), "doc_id", "text", F.col("source").cast("string")).alias("key"),
    )
    sized = stage(sized, "mix-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: map them to fewer first")
    plan_ = quotas([(r["source"], r["n"]) for r in found])
    rows = [{"sid": q.sid, "source": q.source, "source_size": q.size, "target": q.target, "blocks": q.blocks, "passes": q.passes, "rest": q.rest} for q in plan_]
    table = _table(spark, rows, "sid:int,source:string,source_size:bigint,target:double,blocks:int,passes:int,rest:bigint")
    known = table.withColumnRenamed("source", "s")
    out = sized.join(F.broadcast(known), sized["source"].eqNullSafe(known["s"])).drop("s")  # MOST_SOURCES rows at most
    return out.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")), plan_


def mix(docs: DataFrame, seed: int = SEED, shards: int | None = None, with_key: bool = False) -> DataFrame:
    """What the mix takes of every row: doc_id, source, size, source_size, target, taken, shards.

    size: words of the text, 0 for null.  taken: words taken, repeats counted, at
    most twice the size; a last pass may take only the first words of a document.
    shards: output shard of each pass that takes some.  Equal rows, and rows of equal or
    null doc_id, are drawn as separate documents.  A null source is a source of its own,
    after all others.  A very long text is one row of one block, which is then larger.
    An empty table gives an empty result.  Other columns are ignored.  with_key adds
    key, the hash of (seed, doc_id, text, source) that rows are permuted by.
    """
    rows, plan_ = plan(docs, seed)
    spark = docs.sparkSession
    total = sum(q.passes * q.size + q.rest for q in plan_)
    shards = shards or shard_count(total, len(plan_))

    b = rows.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    b = numbered(b, ["sid"], [F.xxhash64(F.lit(seed), "sid", "block"), F.col("block")], "mix-blocks", ("words",))
    b = b.withColumn("room", F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("before_words"))))

    # draws: each full pass over a block, and the partial pass where it has room
    draws = b.select("sid", "block", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("pass"), "passes", "room")
    draws = draws.where((F.col("pass") < F.col("passes")) | (F.col("room") > 0)).select("sid", "block", "pass")
    draws = numbered(draws, ["sid"], [F.xxhash64(F.lit(seed + 1), "sid", "pass", "block"), F.col("pass"), F.col("block")], "mix-draws")
    counted = {r["sid"]: r["n"] for r in draws.groupBy("sid").agg(F.count("*").alias("n")).collect()}  # one row a source
    cuts, widths = leaves(spark, [counted.get(q.sid, 0) for q in plan_], shards, seed)
    step = draws.join(F.broadcast(widths), "sid").withColumn("step", F.floor(F.col("nth") / F.col("width")).cast("long"))
    mine = (F.col("d.sid") == F.col("c.sid")) & (F.col("d.step") == F.col("c.step")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))
    placed = step.alias("d").join(cuts.alias("c"), mine).select("d.sid", "d.block", "d.pass", "c.shard")
    placed = placed.groupBy("sid", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("places"))  # passes of a block: three at most

    b = b.select("sid", "block", "room").join(placed, ["sid", "block"], "left")
    d = rows.join(b, ["sid", "block"])
    # only in the block that a quota ends in is the room less than the words; its rows are taken in order of their key
    inside = W.partitionBy("sid", "block").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("room") - F.coalesce(F.sum("size").over(inside), F.lit(0)))))
    words = lambda x: F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part")).cast("long")
    drawn = F.filter("places", lambda x: words(x) > 0)
    taken = F.coalesce(F.aggregate("places", F.lit(0).cast("long"), lambda a, x: a + words(x)), F.lit(0).cast("long"))
    return d.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        F.coalesce(F.transform(drawn, lambda x: x["shard"]), F.array().cast("array<int>")).alias("shards"), *(["key"] if with_key else []),
    )


def mixed_documents(docs: DataFrame, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """The mix itself: one row for each document and pass that takes some of it.

    Adds to the columns of documents: copy (0, 1), words_taken, shard and place, by which the
    rows of a shard are ordered; a name that documents have already gets underscores
    behind it.  words_taken is below the size where a pass is cut.  place is a hash of the
    row, its number among equal rows and the copy.
    """
    taken = mix(docs, seed, shards, with_key=True)
    names = [fresh(docs, x) for x in ("key", "nth", "taken", "size", "shards")]
    k, n, t, s, h = names
    # equal rows are numbered, so that each meets one row of the plan
    rows = taken.select(F.col("key").alias(k), F.col("taken").alias(t), F.col("size").alias(s), F.col("shards").alias(h))
    rows = rows.withColumn(n, F.row_number().over(W.partitionBy(k).orderBy(t, h)))
    own = docs.withColumn(k, F.xxhash64(F.lit(seed), "doc_id", "text", F.col("source").cast("string")))
    # those that differ in other columns go by a hash of them, so reruns agree (maps don't count in it)
    told = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)])
    own = own.withColumn(n, F.row_number().over(W.partitionBy(k).orderBy(told)))
    copy, shard, taken_words, place = free(docs, "copy", "shard", "words_taken", "place")
    out = own.join(rows, [k, n]).select(*[F.col(f"`{c}`") for c in docs.columns], k, n, t, s, F.posexplode(h).alias(copy, shard))
    words = F.least(F.col(s), F.col(t) - F.col(copy) * F.col(s))
    out = out.withColumn(taken_words, words).where(F.col(taken_words) > 0)
    return out.withColumn(place, F.xxhash64(F.lit(seed), k, n, copy)).drop(k, n, t, s)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source")
