"""Append-only store: atomic publication behind a write gate, conditional insert, guards, ownership changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.constraints import SCHEMA, require
from tidemark.operators.versions import Versions

STATUSES = ("running", "completed", "failed", "partial")
METRICS = ("views", "likes", "comments", "shares")
POST_KEY = ("platform_post_id", "provider_id")
#: New posts that one run may bring; a post's id is made of the run's and its place among them.
MOST_NEW_POSTS = 1 << 24

EVENT = "run_id long, status string, at timestamp_ntz, attempt string"
POSTS = "post_id long, account_id long, platform_post_id string, provider_id long, published_at timestamp_ntz, run_id long, attempt string"


class BrokenRule(ValueError):
    """Rows that the store's rules refuse; nothing of their publication is visible."""


class AppendOnly(TypeError):
    """The store has no such operation."""


def violations(snapshots: DataFrame, posts: DataFrame, ownership: DataFrame, runs: DataFrame) -> DataFrame:
    """rule, n: rows that break each constraint of the store; one scan of the snapshots serves both of their rules."""
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    twice = lambda df, *keys: df.groupBy(*keys).count().where("count > 1")
    known = posts.select("post_id", F.lit(True).alias("known")).dropDuplicates(["post_id"])
    per_post = snapshots.groupBy("post_id").agg(F.count("*").alias("rows"), F.count_if(_negative()).alias("negative"))
    both = per_post.join(known, "post_id", "left").agg(F.coalesce(F.sum("negative"), F.lit(0)).alias("negative"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("rows"))), F.lit(0)).alias("orphans"))
    facts = both.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).cast("long").alias("n")) for rule, c in (("negative_metric", "negative"), ("orphan_snapshot", "orphans"))])))
    parts = [
        facts,
        count("two_open_owners", twice(ownership.where("valid_to is null"), "account_id")),
        count("period_backwards", ownership.where("valid_to <= valid_from")),
        count("duplicate_post", twice(posts, *POST_KEY)),
        count("bad_status", runs.where(~F.col("status").isin(*STATUSES))),
    ]
    return reduce(DataFrame.unionByName, parts)


def _negative():
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(m) < 0, F.lit(False)) for m in METRICS))


def gate(rows: DataFrame) -> None:
    """Raises BrokenRule unless a run's merged posts have keys, each key once, and no metric null or below 0.

    One aggregation by key; only counts reach the driver.
    """
    lacking = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in (*POST_KEY, "account_id", *METRICS)))
    by_key = rows.groupBy(*POST_KEY).agg(F.count("*").alias("times"), F.count_if(lacking).alias("lacking"), F.count_if(_negative()).alias("negative"))
    found = by_key.agg(F.count_if(F.col("times") > 1).alias("duplicate_post"), F.sum("lacking").alias("missing_value"), F.sum("negative").alias("negative_metric")).first()
    broken = {k: n for k, n in found.asDict().items() if n}
    if broken:
        raise BrokenRule(", ".join(f"{k}: {n}" for k, n in broken.items()))


def new_posts(seen: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts that the store lacks; a repeated key comes once."""
    keys = list(POST_KEY)
    return seen.dropDuplicates(keys).join(posts, keys, "left_anti")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of an append-only table that a later state of it has lost or altered, repeats counted; none may be."""
    return before.exceptAll(after.select(*before.columns))


def close_and_open(ownership: DataFrame, account_id: int, client_id: int, at: str) -> DataFrame:
    """Ownership after an account moves: the open period ends at ``at``, another begins.

    Closed periods never change.  Raises if the open period would end before it begins.
    """
    when = F.lit(at).cast("timestamp_ntz")
    mine = (F.col("account_id") == account_id) & F.col("valid_to").isNull()
    if ownership.where(mine & (F.col("valid_from") >= when)).limit(1).count():
        raise ValueError("a period must end after it begins")
    closed = ownership.withColumn("valid_to", F.when(mine, when).otherwise(F.col("valid_to")))
    opened = ownership.sparkSession.range(1).select(F.lit(account_id).cast("long").alias("account_id"), F.lit(client_id).cast("long").alias("client_id"), when.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return closed.unionByName(opened)


def latest_status(events: DataFrame) -> DataFrame:
    """run_id, status: the latest event of each run; at equal times the later in a run's life."""
    life = F.array_position(F.array(*[F.lit(s) for s in ("running", "partial", "failed", "completed")]), F.col("status"))
    return events.groupBy("run_id").agg(F.max_by("status", F.struct("at", life)).alias("status"))


class RunStore:
    """Parquet tables under one folder, written by appends only.

    Every publication of a run is an attempt with an id of its own, and its rows carry it.
    They count once a 'completed' event names the attempt, which is written last: an
    attempt that breaks off stays invisible, and the run can be published again.  There is
    no update and no delete.  One writer at a time may publish for an account.

    Each event is a small file at first.  ``compact`` gathers them into whole versions of the
    event log, so a reader opens few files however many runs there have been.
    """

    #: Event files of their own after which a publication gathers them.
    LOOSE_EVENTS = 500

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.gathered = Versions(spark, f"{self.folder}/_run_events")

    def event(self, run_id: int, status: str, at: str, attempt: str | None = None) -> None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}")
        row = self.spark.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.lit(status).alias("status"), F.lit(at).cast("timestamp_ntz").alias("at"), F.lit(attempt).cast("string").alias("attempt"))
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/run_events")

    def publish(self, run_id: int, at: str, **tables: DataFrame) -> None:
        """Append the rows of one run to some tables, all or none of them."""
        if self._exists("run_events") and not self.states().where((F.col("run_id") == run_id) & (F.col("status") == "completed")).isEmpty():
            raise BrokenRule(f"run {run_id} is completed")
        attempt = uuid.uuid4().hex
        self.event(run_id, "running", at, attempt)
        for name, rows in tables.items():
            own = rows.withColumn("run_id", F.lit(run_id).cast("long")).withColumn("attempt", F.lit(attempt))
            own.write.mode("append").partitionBy("run_id", "attempt").parquet(f"{self.folder}/{name}")
        self.event(run_id, "completed", at, attempt)
        if self._loose_files() > self.LOOSE_EVENTS:
            self.compact()

    def publish_checked(self, run_id: int, at: str, known: dict[str, DataFrame], **tables: DataFrame) -> None:
        """As ``publish``, but only if no declared rule is broken; else BrokenConstraint names them.

        The new rows are checked together with the visible rows of their tables, so a key that
        another run brought already is refused, and with the tables that they refer to: the
        store's own, and those of ``known`` (by the names in ``constraints.SCHEMA``).
        """
        every = {name: self.read(name) for name in SCHEMA if self._exists(name)} | known
        for name, rows in tables.items():
            own = rows.withColumn("run_id", F.lit(run_id).cast("long"))
            every[name] = every[name].unionByName(own, allowMissingColumns=True) if name in every else own
        require(every)
        self.publish(run_id, at, **tables)

    def sink(self, table: str, first_run: int, at: str) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each micro-batch is the run ``first_run`` + its number.

        A batch that is given again after its run was completed is dropped; one that broke off
        is published as another attempt, and the rows of the first stay invisible.
        """

        def write(rows: DataFrame, batch: int) -> None:
            if not self.completed().where(F.col("run_id") == first_run + batch).isEmpty():
                return
            self.publish(first_run + batch, at, **{table: rows})

        return write

    def publish_batch(self, run_id: int, account_id: int, provider_id: int, merged: DataFrame, at: str) -> None:
        """One account's merged posts: new posts, a snapshot of each, and the run's account row, all or none.

        merged: platform_post_id, published_at and the four metrics, one row a post.  Posts that
        the store has keep their id.  posts_expected is posts_found: the vendors tell no more.
        """
        rows = merged.withColumn("account_id", F.lit(account_id).cast("long")).withColumn("provider_id", F.lit(provider_id).cast("long"))
        gate(rows)
        known = self.posts().where(F.col("provider_id") == provider_id).select(*POST_KEY, "post_id")
        found = rows.count()
        if found > MOST_NEW_POSTS:
            raise BrokenRule(f"more than {MOST_NEW_POSTS} posts in one run")
        from pyspark.sql import Window as W

        nth = F.row_number().over(W.partitionBy("provider_id").orderBy("platform_post_id")) - 1  # one account's posts
        fresh = new_posts(rows, known).withColumn("post_id", F.lit(run_id).cast("long") * MOST_NEW_POSTS + nth)
        fresh = fresh.select("post_id", "account_id", *POST_KEY, "published_at")
        ids = known.select(*POST_KEY, "post_id").unionByName(fresh.select(*POST_KEY, "post_id"))
        snapshots = rows.join(ids, list(POST_KEY)).select("post_id", *[F.col(m).cast("long").alias(m) for m in METRICS], F.lit(at).cast("timestamp_ntz").alias("scraped_at"))
        summary = self.spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in (("account_id", account_id), ("posts_expected", found), ("posts_found", found))])
        self.publish(run_id, at, posts=fresh, snapshots=snapshots, run_accounts=summary)

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _loose(self) -> DataFrame:
        """Events in files of their own, with the file's name, but for those that are gathered."""
        loose = self.spark.read.schema(EVENT).parquet(f"{self.folder}/run_events").select("*", F.col("_metadata.file_name").alias("file"))
        whole = self.gathered.read()
        return loose if whole is None else loose.join(whole.select("file").distinct(), "file", "left_anti").select(*loose.columns)

    def _files(self) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/run_events")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().endswith(".parquet")]

    def _loose_files(self) -> int:
        return len(self._files())

    def compact(self) -> None:
        """Gather all events into the next version of the log.

        The version names the files that its events came from, and readers skip those.  Files
        are deleted a version later, when no reader is at the version before any more.
        """
        before, files = self.gathered.read(), self._files()
        there = self.spark.createDataFrame([(f.getName(),) for f in files], "file string")
        old = set() if before is None else {r.file for r in there.join(before.select("file").distinct(), "file", "left_semi").collect()}
        rows = self._loose() if before is None else before.unionByName(self._loose())
        self.gathered.write(rows.repartition(1 + len(files) // 100_000))
        for path in files:
            if path.getName() in old:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, False)
        self.gathered.keep(2)

    def events(self) -> DataFrame:
        whole, names = self.gathered.read(), [c.split()[0] for c in EVENT.split(", ")]
        loose = self._loose().select(*names)
        return loose if whole is None else whole.select(*names).unionByName(loose)

    def states(self) -> DataFrame:
        return latest_status(self.events())

    def completed(self) -> DataFrame:
        """run_id, attempt of each completed run: the attempt that counts."""
        if not self._exists("run_events"):
            return self.spark.createDataFrame([], "run_id long, attempt string")
        done = self.states().where("status = 'completed'").select("run_id")
        named = self.events().where("status = 'completed' and attempt is not null").groupBy("run_id").agg(F.max_by("attempt", "at").alias("attempt"))
        return named.join(done, "run_id")

    def read(self, table: str) -> DataFrame:
        """Rows of completed attempts of completed runs; Catalyst picks the join by the size of the run list."""
        return self.spark.read.parquet(f"{self.folder}/{table}").join(self.completed(), ["run_id", "attempt"], "left_semi")

    def posts(self) -> DataFrame:
        """Visible posts; none before the first publication."""
        return self.read("posts") if self._exists("posts") else self.spark.createDataFrame([], POSTS)

    def update(self, *_: object, **__: object) -> None:
        raise AppendOnly("rows of the store are never changed")

    delete = overwrite = update
