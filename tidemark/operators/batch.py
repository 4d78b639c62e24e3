"""A recorded batch of jobs in the runner's order: skip, call with retries, time out, pause, merge, write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import health
from tidemark.staging import staged

METRICS = ("views", "likes", "comments", "shares")
VENDORS = ("A", "B")


def called(attempts: DataFrame, limit: float = health.JOB_SECONDS) -> DataFrame:
    """job_id, failed, reason, ended (seconds from its start) of each job whose two vendors are called at once.

    attempts: job_id, vendor, attempt (from 1), outcome, retry_after, jitter, took (seconds).
    Each vendor's call ends as ``health.retried`` has it, its time being that of its attempts
    and of the waits between them.  A job fails when the first call fails (the reason is its
    status), or at the limit; it succeeds when both are accepted by then.  A vendor that
    wasn't called at all counts as exhausted at once.
    """
    keyed = attempts.withColumn("call", F.struct("job_id", "vendor"))
    made = health.retried(keyed, "call").select("call", "status", F.col("attempts").alias("made"), "waited")
    rows = keyed.join(made, "call").where(F.col("attempt") <= F.col("made"))
    ends = rows.groupBy("call").agg((F.sum("took") + F.max("waited")).alias("ended"), F.max("status").alias("status"))
    bad = F.col("status") != "accepted"
    per = ends.groupBy("call.job_id").agg(
        F.count("*").alias("calls"), F.max("ended").alias("last"), F.min(F.when(bad, F.struct("ended", "status"))).alias("first"),
    )
    lacking = F.col("calls") < len(VENDORS)
    reason = F.when(lacking, "exhausted").when(F.col("first.ended") <= limit, F.col("first.status")).when(F.col("last") > limit, "timeout")
    ended = F.when(lacking, 0.0).when(F.col("first.ended") <= limit, F.col("first.ended")).otherwise(F.least("last", F.lit(float(limit))))
    return per.select("job_id", reason.isNotNull().alias("failed"), reason.alias("reason"), ended.alias("ended"))


def run(jobs: DataFrame, attempts: DataFrame, posts: DataFrame, limit: float = health.JOB_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(results, snapshots) of recorded batches.

    jobs: job_id, account_id, ord, batch; an account's jobs are in one batch.  posts: job_id,
    vendor, platform_post_id and the metrics, of complete answers.

    results: job_id, account_id, outcome, reason, ended, and for a success posts_a, posts_b,
    reconciled, overlap, new_posts.  A job of an account that is flagged by then is skipped:
    it neither counts as done nor as failed.  A failure may pause its batch; the jobs behind it
    aren't run.  snapshots: job_id, account_id, ord, platform_post_id and the higher of both
    vendors' metrics, of successes only; a post is new where no earlier success of its account
    had it.
    """
    ends = called(attempts, limit)
    # without any recorded call a job fails as exhausted
    all_jobs = jobs.join(ends, "job_id", "left").withColumn("failed", F.coalesce("failed", F.lit(True))).withColumn("reason", F.when(F.col("failed"), F.coalesce("reason", F.lit("exhausted"))))
    judged = health.skipped(all_jobs)
    stops = health.paused(judged)
    judged = staged(judged.join(stops, "batch", "left"), "judged-jobs")
    behind = F.coalesce(F.col("ord") > F.col("pause_ord"), F.lit(False))
    outcome = F.when(behind, "not_run").when(F.col("skipped"), "skipped").when(F.col("failed"), "failure").otherwise("success")
    judged = judged.withColumn("outcome", outcome)

    good = judged.where("outcome = 'success'").select("job_id", "account_id", "ord")
    mine = posts.where(F.col("vendor").isin(*VENDORS)).join(good, "job_id")
    has = lambda v: F.max((F.col("vendor") == v).cast("int"))
    merged = mine.groupBy("job_id", "account_id", "ord", "platform_post_id").agg(*[F.max(m).alias(m) for m in METRICS], has("A").alias("in_a"), has("B").alias("in_b"))
    merged = staged(merged, "merged-posts")
    first = merged.groupBy("account_id", "platform_post_id").agg(F.min("ord").alias("first_ord"))
    told = merged.join(first, ["account_id", "platform_post_id"])
    counts = told.groupBy("job_id").agg(
        F.sum("in_a").alias("posts_a"), F.sum("in_b").alias("posts_b"), F.count("*").alias("reconciled"), F.sum(F.col("in_a") * F.col("in_b")).alias("overlap"), F.count_if(F.col("ord") == F.col("first_ord")).alias("new_posts"),
    )
    real = F.col("outcome").isin("success", "failure")
    number = lambda c: F.when(F.col("outcome") == "success", F.coalesce(c, F.lit(0).cast("long"))).alias(c)
    results = judged.join(counts, "job_id", "left").select(
        "job_id", "account_id", "outcome", F.when(F.col("outcome") == "failure", F.col("reason")).alias("reason"), F.when(real, F.coalesce("ended", F.lit(0.0))).alias("ended"),
        *[number(c) for c in ("posts_a", "posts_b", "reconciled", "overlap", "new_posts")],
    )
    return results, merged.select("job_id", "account_id", "ord", "platform_post_id", *METRICS)
