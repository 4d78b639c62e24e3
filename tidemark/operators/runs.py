"""Questions about collection runs: what vanished, coverage, frequency, staleness, stuck runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(runs: DataFrame) -> DataFrame:
    """Usable runs of each platform, newest first."""
    turn = W.partitionBy("provider_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    return runs.where(F.col("status").isin("completed", "partial")).select("run_id", "provider_id", "started_at", F.row_number().over(turn).alias("rn"))


def _vanished(run_snapshots: DataFrame, runs: DataFrame) -> DataFrame:
    """Posts in a previous run and in no latest one: the newest run that has them, in one pass."""
    marks = ranked(runs).where(F.col("rn") <= 2).select("run_id", "rn")
    seen = run_snapshots.select("post_id", "run_id").join(marks, "run_id").groupBy("post_id").agg(F.min("rn").alias("newest"))
    return seen.where(F.col("newest") == 2).select("post_id")


def disappeared(snapshots: DataFrame, runs: DataFrame, posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Posts in a previous run and in no latest one, once for each platform's previous run."""
    gone = _vanished(snapshots, runs)
    previous = ranked(runs).where(F.col("rn") == 2).select("provider_id")
    named = gone.join(posts.select("post_id", "platform_post_id", "account_id"), "post_id").join(accounts.select("account_id", "platform_handle"), "account_id")
    # one row a platform: the array keeps this a projection instead of a nested-loop join
    ids = previous.agg(F.collect_list("provider_id").alias("ids"))
    return named.join(F.broadcast(ids)).select("post_id", "platform_post_id", "account_id", "platform_handle", F.explode("ids").alias("provider_id"))


def disappeared_by_platform(run_snapshots: DataFrame, runs: DataFrame, posts: DataFrame, accounts: DataFrame) -> DataFrame:
    """Posts of a platform in its previous run and not in its latest."""
    gone = _vanished(run_snapshots, runs)
    named = gone.join(posts.select("post_id", "platform_post_id", "account_id", "provider_id"), "post_id")
    return named.join(accounts.select("account_id", "platform_handle"), "account_id").select("post_id", "platform_post_id", "account_id", "platform_handle", "provider_id")


def health(runs: DataFrame, run_accounts: DataFrame, accounts: DataFrame, platforms: DataFrame) -> DataFrame:
    found = F.coalesce("posts_found", F.lit(0))
    share = F.when(F.col("posts_expected") > 0, F.round(100.0 * found / F.col("posts_expected"), 1).cast("double"))
    rows = run_accounts.join(runs, "run_id").join(accounts.select("account_id", "platform_handle"), "account_id").join(platforms.withColumnRenamed("name", "provider_name"), "provider_id")
    return rows.select("run_id", "started_at", "status", "provider_name", "platform_handle", "posts_expected", "posts_found", (F.col("posts_expected") - found).alias("post_deficit"), share.alias("coverage_pct"))


def weekly(runs: DataFrame, run_accounts: DataFrame, accounts: DataFrame, as_of: str, weeks: int = 5) -> DataFrame:
    """Runs of each account by week since ``weeks`` before ``as_of``."""
    since = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(7 * weeks))
    recent = runs.where(F.col("started_at") >= since).select("run_id", F.date_trunc("week", "started_at").cast("timestamp_ntz").alias("week"))
    rows = run_accounts.select("run_id", "account_id").join(recent, "run_id").join(accounts.select("account_id", "platform_handle"), "account_id")
    return rows.groupBy("platform_handle", "week").agg(F.count("run_id").alias("scrape_count"))


def weekly_spine(runs: DataFrame, run_accounts: DataFrame, accounts: DataFrame, as_of: str, weeks: int = 5) -> DataFrame:
    """As ``weekly``, with a 0 for an account's weeks without a run."""
    start = F.date_trunc("week", F.lit(as_of).cast("timestamp_ntz"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(weeks)), lambda i: (start - F.make_dt_interval(days=7 * i)).cast("timestamp_ntz"))
    spine = accounts.select("platform_handle", F.explode(steps).alias("week"))
    return spine.join(weekly(runs, run_accounts, accounts, as_of, weeks), ["platform_handle", "week"], "left").select("platform_handle", "week", F.coalesce("scrape_count", F.lit(0)).alias("scrape_count"))


def staleness(snapshots: DataFrame, posts: DataFrame, accounts: DataFrame, chosen: DataFrame, as_of: str) -> DataFrame:
    """Age of the newest snapshot of each chosen account, in seconds at ``as_of``."""
    mine = accounts.join(chosen, "account_id", "left_semi").select("account_id", "platform_handle")
    rows = snapshots.select("post_id", "scraped_at", "views").join(posts.select("post_id", "account_id").join(mine, "account_id"), "post_id")
    last = rows.groupBy("platform_handle", "account_id").agg(F.max("scraped_at").alias("last_scraped"), F.max("views").alias("last_known_views"))
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("last_scraped").cast("timestamp"))
    return last.select("platform_handle", "account_id", "last_scraped", seconds.alias("staleness_seconds"), "last_known_views")


def reaped(runs: DataFrame, as_of: str, minutes: int = 10) -> DataFrame:
    """Events that fail the runs still running after ``minutes``; appended, never an update."""
    cut = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(minutes))
    stuck = runs.where((F.col("status") == "running") & (F.col("started_at") < cut))
    return stuck.select("run_id", F.lit("failed").alias("status"), F.lit(as_of).cast("timestamp_ntz").alias("ended_at"), F.concat(F.lit("Reaped: exceeded "), F.lit(str(minutes)), F.lit(" minute timeout")).alias("error_message"))
