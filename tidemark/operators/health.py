"""Failure streaks, skipped jobs, batch pauses and alerts, retries, timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X

# When an account is flagged, a batch pauses, a call or a job is given up.
STREAK = 3
RATE, LEAST_SHARE, LEAST_JOBS = 0.20, 0.10, 5
MOST_ATTEMPTS = 4
JOB_SECONDS = 600
RETRIED = ("partial", "rate_limited", "timeout", "unavailable")


def streaks(jobs: DataFrame, unflags: DataFrame | None = None) -> DataFrame:
    """Consecutive failures of each account at each job, and whether it is flagged by then.

    An island of failures starts after each success; its running count is the streak.
    The flag stays once set.  unflags (account_id, ord) clear the flag and the count
    by hand: what comes after one starts anew.
    """
    keys, columns = ["account_id"], jobs.columns
    if unflags is not None:
        cleared = jobs.select("*", F.lit(0).alias("clear")).unionByName(unflags.select("account_id", "ord", F.lit(1).alias("clear")), allowMissingColumns=True)
        so_far = W.partitionBy("account_id").orderBy("ord", F.desc("clear")).rowsBetween(W.unboundedPreceding, 0)
        jobs = cleared.withColumn("epoch", F.sum("clear").over(so_far)).where("clear = 0").drop("clear")
        keys = ["account_id", "epoch"]
    past = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = jobs.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(past))
    run = W.partitionBy(*keys, "island").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("consecutive_failures", F.sum(F.col("failed").cast("int")).over(run).cast("long"))
    rows = rows.withColumn("flagged", F.max(F.col("consecutive_failures") >= STREAK).over(past))
    if unflags is not None:
        before = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
        rows = rows.withColumn("skipped", F.coalesce(F.max("flagged").over(before), F.lit(False)))
        return rows.select(*columns, "consecutive_failures", "flagged", "skipped")
    return rows.drop("island")


def last_states(events: DataFrame, quiet: str) -> DataFrame:
    """account_id, last_ord, seen, run, flagged after an account's events so far, for a stream that goes on from there.

    events: account_id, ord, ts, failed, clear (an unflag).  An unflag or an event that comes
    longer than ``quiet`` after the one before starts a new streak; only an unflag clears the flag.
    """
    line = W.partitionBy("account_id").orderBy("ord", F.desc("clear"))
    late = F.coalesce(F.col("ts") - F.lag("ts").over(line) > F.expr(f"interval {quiet}"), F.lit(False))
    past = line.rowsBetween(W.unboundedPreceding, 0)
    rows = events.withColumn("quiet", late).withColumn("epoch", F.sum(F.col("clear").cast("int")).over(past))
    rows = rows.withColumn("island", F.sum(F.when(F.col("clear") | ~F.col("failed") | F.col("quiet"), 1).otherwise(0)).over(past))
    counted = W.partitionBy("account_id", "epoch", "island").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("run", F.when(F.col("clear"), 0).otherwise(F.sum((F.col("failed") & ~F.col("clear")).cast("int")).over(counted)).cast("long"))
    epochs = rows.groupBy("account_id", "epoch").agg(F.max_by(F.struct(F.col("ord").alias("last_ord"), F.col("ts").alias("seen"), "run"), F.struct("ord", (~F.col("clear")).alias("job"))).alias("last"), F.max(F.col("run") >= STREAK).alias("flagged"))
    return epochs.groupBy("account_id").agg(F.max_by(F.struct("last", "flagged"), "epoch").alias("s")).select("account_id", "s.last.last_ord", "s.last.seen", "s.last.run", "s.flagged")


def skipped(jobs: DataFrame) -> DataFrame:
    """Jobs that come after their account was flagged."""
    before = W.partitionBy("account_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    rows = streaks(jobs).withColumn("skipped", F.coalesce(F.max("flagged").over(before), F.lit(False)))
    return rows.select(*jobs.columns, "skipped")


def flagged_accounts(jobs: DataFrame) -> DataFrame:
    return streaks(jobs).groupBy("account_id").agg(F.max("flagged").alias("flagged"), F.max("consecutive_failures").alias("longest_streak"))


def _counted(jobs: DataFrame, batch: str) -> DataFrame:
    """Jobs with what their batch has done and failed so far, and whether it pauses here.

    A column ``skipped``, if there is one, marks jobs that count as part of the batch but
    neither as done nor as failed.
    """
    past = W.partitionBy(batch).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    real = ~F.col("skipped") if "skipped" in jobs.columns else F.lit(True)
    bad = real & F.col("failed")
    rows = jobs.withColumn("done", F.count_if(real).over(past)).withColumn("bad", F.count_if(bad).over(past)).withColumn("total", F.count("*").over(W.partitionBy(batch)))
    least = F.greatest(F.lit(LEAST_JOBS), F.floor(F.col("total") * LEAST_SHARE))
    return rows.withColumn("pauses", bad & (F.col("done") >= least) & (F.col("bad") / F.col("done") > RATE))


def paused(jobs: DataFrame, batch: str = "batch") -> DataFrame:
    """The job at which each batch pauses, if any: a failure that brings the failed share of
    the jobs so far above a fifth, once max(5, a tenth of the batch) have ended."""
    return _counted(jobs, batch).where("pauses").groupBy(batch).agg(F.min("ord").alias("pause_ord"))


def alerts(jobs: DataFrame, batch: str = "batch") -> DataFrame:
    """One alert row for each batch that pauses: where, the counts then, and a message."""
    first = _counted(jobs, batch).where("pauses").groupBy(batch).agg(F.min_by(F.struct("ord", "done", "bad"), "ord").alias("at"))
    share = F.round(100 * F.col("at.bad") / F.col("at.done")).cast("long")
    text = F.concat(F.lit("batch "), F.col(batch).cast("string"), F.lit(" paused: "), F.col("at.bad").cast("string"), F.lit(" of "), F.col("at.done").cast("string"), F.lit(" jobs failed ("), share.cast("string"), F.lit("%)"))
    return first.select(batch, F.col("at.ord").alias("pause_ord"), F.col("at.bad").alias("failed"), F.col("at.done").alias("completed"), text.alias("message"))


def attempted(jobs: DataFrame, batch: str = "batch") -> DataFrame:
    """Jobs up to and with the one that pauses their batch."""
    stop = paused(jobs, batch)
    return jobs.join(stop, batch, "left").where(F.col("pause_ord").isNull() | (F.col("ord") <= F.col("pause_ord"))).drop("pause_ord")


def accepted_attempt(attempts: DataFrame, key: str = "job_id") -> DataFrame:
    """First complete response among the first four attempts; an incomplete one counts as failed."""
    ok = attempts.where((F.col("attempt") <= MOST_ATTEMPTS) & F.col("is_complete"))
    return ok.groupBy(key).agg(F.min("attempt").alias("attempt"))


def retried(attempts: DataFrame, key: str = "job_id") -> DataFrame:
    """What became of each call: key, status, attempts made, seconds waited between them.

    attempts: key, attempt (from 1), outcome, retry_after (seconds, for rate_limited), jitter.
    A complete answer ends a call as accepted; an outcome outside RETRIED is raised at once;
    after four attempts of the others the call is exhausted.  Between attempts a rate
    limit's own delay is waited, else the doubling one.  Later recorded attempts don't count.
    """
    final = ~F.col("outcome").isin(*RETRIED)
    rows = attempts.where(F.col("attempt") <= MOST_ATTEMPTS)
    wait = F.when((F.col("outcome") == "rate_limited") & F.col("retry_after").isNotNull(), F.col("retry_after").cast("double")).otherwise(X.backoff_seconds(F.col("attempt") - 1, F.coalesce("jitter", F.lit(0.0))))
    past = W.partitionBy(key).orderBy("attempt").rowsBetween(W.unboundedPreceding, -1)
    made = rows.withColumn("over", F.coalesce(F.max(final).over(past), F.lit(False))).where("not over")
    slept = F.sum(F.when(~final & (F.col("attempt") < MOST_ATTEMPTS), wait))
    out = made.groupBy(key).agg(F.max_by("outcome", "attempt").alias("last"), F.count("*").alias("attempts"), F.coalesce(slept, F.lit(0.0)).alias("waited"))
    status = F.when(F.col("last") == "complete", "accepted").when(F.col("last").isin(*RETRIED), "exhausted").otherwise("raised")
    return out.select(key, status.alias("status"), "attempts", "waited")


def timed(jobs: DataFrame, most: int = JOB_SECONDS) -> DataFrame:
    """Adds elapsed (seconds from started_at to finished_at) and timed_out, whether the job ran longer than allowed."""
    rows = jobs.withColumn("elapsed", X.elapsed_seconds(F.col("started_at"), F.col("finished_at")))
    return rows.withColumn("timed_out", F.coalesce(F.col("elapsed") > most, F.lit(False)))


def failure_rate(status: Column) -> Column:
    """Share of FAILED among those not INTERRUPTED; 0 for none."""
    return F.coalesce(F.try_divide(F.count_if(status == "failed"), F.count_if(status != "interrupted")), F.lit(0.0))
