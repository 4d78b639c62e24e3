"""Streaming forms: windowed counts with late data, and failure streaks kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState

from tidemark.operators.health import STREAK


def windowed_counts(events: DataFrame, size: str = "1 hour", step: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by type and window; tumbling, or sliding with a step. Later ones than ``late`` drop."""
    times = F.window("ts", size, step) if step else F.window("ts", size)
    rows = events.withWatermark("ts", late).groupBy(times, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select("window.start", "window.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("window.start", "window.end", "user_id", "n")


def _streak(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    run, flagged = state.get if state.exists else (0, False)
    rows = pd.concat(list(batches)).sort_values("ord")
    out = []
    for ord_, failed in zip(rows["ord"], rows["failed"]):
        run = run + 1 if failed else 0
        flagged = flagged or run >= STREAK
        out.append((key[0], ord_, failed, run, flagged))
    state.update((run, flagged))
    yield pd.DataFrame(out, columns=["account_id", "ord", "failed", "consecutive_failures", "flagged"])


def streaks(jobs: DataFrame) -> DataFrame:
    """As the batch operator, job by job as they come; jobs of an account must come in order of ``ord``."""
    return jobs.groupBy("account_id").applyInPandasWithState(
        _streak, "account_id long, ord long, failed boolean, consecutive_failures long, flagged boolean", "run long, flagged boolean", "append", "NoTimeout"
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATCHED = "account_id long, ord long, failed boolean, consecutive_failures long, flagged boolean, skipped boolean"
#: What ``watched`` starts from: the last job of each account before the stream.
BEFORE = "account_id long, last_ord long, seen timestamp, run long, flagged boolean"


class FailureWatch(StatefulProcessor):
    """Streaks of one account, event by event.

    State: the streak with its flag and the ords of the last events (one value, so that an
    event that is delivered again is dropped), and a timer that forgets an account that has
    been quiet.  An account that is flagged is never forgotten: only an unflag clears it.
    The state is read and written once for all rows of a batch, since each call goes to the JVM.
    """

    def __init__(self, streak: int, quiet_ms: int):
        self.streak, self.quiet = streak, quiet_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "run long, flagged boolean, seen long, timer long, ords array<long>, clears array<boolean>, ats array<long>")

    def _settle(self, run: int, flagged: bool, seen: int, timer: int | None, taken: dict) -> None:
        """Keep the state, with the events within quiet of the last one, and set the timer anew; without one while the account is flagged."""
        due = None if flagged else seen + self.quiet
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        kept = [(*k, at) for k, at in taken.items() if at >= seen - self.quiet]
        self.now.update((run, flagged, seen, due, *([e[i] for e in kept] for i in range(3))))

    # Spark gives the arguments of these by name
    def handleInitialState(self, key, initialState, timerValues) -> None:
        before = initialState
        self._settle(before.run, before.flagged, before.ms, None, {(before.last_ord, False): before.ms})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        run, flagged, seen, timer, *events = self.now.get() or (0, False, None, None, [], [], [])
        taken = {(ord_, clear): at for ord_, clear, at in zip(*events)}
        out = []
        # an unflag comes before the job of its own place
        for r in sorted(rows, key=lambda r: (r.ord, not r.clear)):
            if (r.ord, r.clear) in taken:
                continue
            taken[r.ord, r.clear] = at = r.ms
            if seen is not None and at - seen > self.quiet:
                run = 0
            seen = at if seen is None else max(seen, at)
            if r.clear:
                run, flagged = 0, False
                continue
            skipped = flagged
            run = run + 1 if r.failed else 0
            flagged = flagged or run >= self.streak
            out.append(Row(account_id=key[0], ord=r.ord, failed=r.failed, consecutive_failures=run, flagged=flagged, skipped=skipped))
        if seen is not None:
            self._settle(run, flagged, seen, timer, taken)
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.now.clear()
        yield from ()

    def close(self) -> None:
        pass


def watched(events: DataFrame, before: DataFrame | None = None, quiet: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Streaks of a stream of jobs and unflags: each job with its streak, flag and whether it is skipped.

    events: account_id, ord, ts, failed, clear.  A row with clear is an unflag: the count and the
    flag of its account start anew, before the job of the same ord if there is one.  Events of
    an account come in order of ord; one that comes again within ``quiet`` is dropped, one
    later than ``late`` is dropped by its watermark.  An account that had no event for
    longer than ``quiet`` starts a new streak; its state is given up, unless it is flagged.
    before: rows of BEFORE, the state from which the stream goes on.

    The state lives in RocksDB, so the session must name that provider (see ``with_rocksdb``).
    """
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    first = None if before is None else before.withColumn("ms", F.unix_millis("seen")).groupBy("account_id")
    keyed = events.withWatermark("ts", late).withColumn("ms", F.unix_millis("ts")).groupBy("account_id")
    return keyed.transformWithState(FailureWatch(STREAK, ms), WATCHED, "append", "eventTime", initialState=first)


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def drained(rows: DataFrame, folder: str, checkpoint: str) -> None:
    """Append all that a stream has now to parquet files, and end; run again, it goes on where it was."""
    q = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
