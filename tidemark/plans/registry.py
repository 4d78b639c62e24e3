"""Every query by name, with the SQL that checks it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import asof, batch, constraints, health, markup, merge, metrics, ownership, reconcile, rollout, rules, runs, store, uilog, versions
from tidemark.sources import fleet, recorded
from tidemark.sources.bindings import Tables, sql
from tidemark.staging import shared_folder
from tidemark.streaming import monitor, replay

AS_OF = "1998-09-01"
CLIENT, CLIENT_ID = "NATION_7", 7
OWNED = "o.account_id = p.account_id and p.published_at >= o.valid_from and (p.published_at < o.valid_to or o.valid_to is null)"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            _SQL[f.__name__] = sql(oracle)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- marks and attribution ---------------------------------------------------------


@query(f"""select c.client_id, c.name client_name, cast(sum(max_views) as bigint) total_high_water_views
    from hwm join posts p using (post_id) join ownership o on {OWNED} join clients c on c.client_id = o.client_id group by all""")
def q1_client_hwm(t: Tables) -> DataFrame:
    return metrics.client_totals(t.snapshots(), t.posts(), t.ownership(), t.clients())


@query("""select post_id, platform_post_id, s.views latest_views, max_views highest_views, s.likes latest_likes, max_likes highest_likes, s.comments latest_comments, max_comments highest_comments, s.scraped_at latest_scrape_time
    from (select *, row_number() over (partition by post_id order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) rn from snapshots) s join hwm using (post_id) join posts using (post_id)
    where rn = 1 and (s.views < max_views or s.likes < max_likes or s.comments < max_comments or s.shares < max_shares)""")
def q2_regressions(t: Tables) -> DataFrame:
    return metrics.regressions(t.snapshots(), t.posts())


RANKED = "ranked as (select run_id, provider_id, row_number() over (partition by provider_id order by started_at desc, run_id desc) rn from runs where status in ('completed', 'partial'))"


@query(f"""with {RANKED}, prev as (select distinct post_id from run_snapshots join ranked using (run_id) where rn = 2), latest as (select distinct post_id from run_snapshots join ranked using (run_id) where rn = 1)
    select post_id, platform_post_id, account_id, platform_handle, r.provider_id from prev join posts using (post_id) join (select account_id, platform_handle from accounts) using (account_id) cross join (select provider_id from ranked where rn = 2) r
    where post_id not in (select post_id from latest)""")
def q3_disappeared(t: Tables) -> DataFrame:
    return runs.disappeared(t.run_snapshots(), t.runs(), t.posts(), t.accounts())


@query(f"""with {RANKED}, prev as (select distinct post_id, r.provider_id from run_snapshots join ranked r using (run_id) where rn = 2), latest as (select distinct post_id, r.provider_id from run_snapshots join ranked r using (run_id) where rn = 1)
    select post_id, platform_post_id, account_id, platform_handle, p.provider_id from prev join posts p using (post_id) join (select account_id, platform_handle from accounts) using (account_id)
    where not exists (select 1 from latest l where l.post_id = prev.post_id and l.provider_id = prev.provider_id)""")
def q3_disappeared_by_platform(t: Tables) -> DataFrame:
    return runs.disappeared_by_platform(t.run_snapshots(), t.runs(), t.posts(), t.accounts())


@query("""select run_id, started_at, status, f.name provider_name, platform_handle, posts_expected, posts_found, posts_expected - coalesce(posts_found, 0) post_deficit,
    case when posts_expected > 0 then cast(round(100.0 * coalesce(posts_found, 0) / posts_expected, 1) as double) end coverage_pct
    from run_accounts join runs r using (run_id) join accounts a using (account_id) join platforms f on f.provider_id = r.provider_id""")
def q4_health(t: Tables) -> DataFrame:
    # a run is a platform's month here, so there are few
    return runs.health(F.broadcast(t.runs()), t.run_accounts(), t.accounts(), t.platforms())


@query(f"""select c.name owning_client_at_publish, count(distinct p.post_id) post_count, cast(sum(max_views) as bigint) total_views
    from posts p join (select account_id from ownership where client_id = {CLIENT_ID} and valid_to is null) cur using (account_id) join ownership o on {OWNED} join clients c on c.client_id = o.client_id join hwm on hwm.post_id = p.post_id group by c.client_id, c.name""")
def q5_attribution(t: Tables) -> DataFrame:
    return metrics.attribution(t.snapshots(), t.posts(), t.ownership(), t.clients(), CLIENT_ID)


@query(f"""select c.name owning_client_at_publish, count(distinct p.post_id) post_count, cast(sum(max_views) as bigint) total_views
    from posts p join (select account_id from ownership where client_id = {CLIENT_ID + 1} and valid_to is null) cur using (account_id) join ownership o on {OWNED} join clients c on c.client_id = o.client_id join hwm on hwm.post_id = p.post_id group by c.client_id, c.name""")
def q5_prepared(t: Tables) -> DataFrame:
    return metrics.attribution_prepared(t.snapshots(), t.posts(), t.ownership(), t.clients(), CLIENT_ID + 1)


@query(f"""select c.name client_name, cast(sum(max_views) as bigint) total_high_water_views from hwm join posts p using (post_id) join ownership o on {OWNED} join clients c on c.client_id = o.client_id where c.name = '{CLIENT}' group by c.name""")
def q6_total(t: Tables) -> DataFrame:
    return metrics.client_total(t.snapshots(), t.posts(), t.ownership(), t.clients(), CLIENT)


@query(f"""select p.post_id, max_views from hwm join posts p using (post_id) join ownership o on {OWNED} join clients c on c.client_id = o.client_id where c.name = '{CLIENT}'""")
def q9_client_posts(t: Tables) -> DataFrame:
    return metrics.client_posts(t.snapshots(), t.posts(), t.ownership(), t.clients(), CLIENT)


WEEKLY = f"select platform_handle, cast(date_trunc('week', started_at) as timestamp) \"week\", count(run_id) scrape_count from run_accounts join runs using (run_id) join (select account_id, platform_handle from accounts) using (account_id) where started_at >= timestamp '{AS_OF}' - interval 35 day group by all"


@query(WEEKLY)
def q7_weekly(t: Tables) -> DataFrame:
    return runs.weekly(t.runs(), t.run_accounts(), t.accounts(), AS_OF)


@query(f"""with counted as ({WEEKLY}), spine as (select platform_handle, cast(date_trunc('week', timestamp '{AS_OF}') as timestamp) - to_days(cast(7 * i as integer)) \"week\" from accounts cross join range(6) r(i))
    select platform_handle, \"week\", coalesce(scrape_count, 0) scrape_count from spine left join counted using (platform_handle, \"week\")""")
def q7_weekly_spine(t: Tables) -> DataFrame:
    return runs.weekly_spine(t.runs(), t.run_accounts(), t.accounts(), AS_OF)


@query(f"""select platform_handle, account_id, max(scraped_at) last_scraped, cast(epoch(timestamp '{AS_OF}') - epoch(max(scraped_at)) as bigint) staleness_seconds, max(views) last_known_views
    from accounts join (select post_id, account_id from posts) using (account_id) join snapshots using (post_id) where account_id in (select c_custkey from customer where c_acctbal < 0) group by all""")
def q8_staleness(t: Tables) -> DataFrame:
    chosen = t.raw("customer").where("c_acctbal < 0").select(F.col("c_custkey").cast("long").alias("account_id"))
    return runs.staleness(t.snapshots(), t.posts(), t.accounts(), chosen, AS_OF)


@query(f"""select run_id, 'failed' status, timestamp '{AS_OF}' ended_at, 'Reaped: exceeded 10 minute timeout' error_message from runs where run_id % 5 = 0 and started_at < timestamp '{AS_OF}' - interval 10 minute""")
def q10_stale_runs(t: Tables) -> DataFrame:
    stuck = F.when(F.pmod("run_id", F.lit(5)) == 0, "running").otherwise(F.col("status"))
    return runs.reaped(t.runs().withColumn("status", stuck), AS_OF)


@query("select * from hwm")
def hwm_per_post(t: Tables) -> DataFrame:
    return metrics.high_water(t.snapshots())


@query("select * from hwm")
def hwm_incremental(t: Tables) -> DataFrame:
    cut = F.col("scraped_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    return metrics.merged_high_water(metrics.high_water(t.snapshots().where(cut)), t.snapshots().where(~cut))


@query("select post_id, max_views from hwm order by max_views desc, post_id limit 100")
def top_posts(t: Tables) -> DataFrame:
    return metrics.ranked_by_views(t.snapshots(), 100)


@query("""select post_id, scraped_at, views, likes, comments, shares from (select *, row_number() over (partition by post_id order by l_shipdate desc, l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) rn from snapshots) where rn = 1""")
def latest_snapshot(t: Tables) -> DataFrame:
    return metrics.latest_snapshot(t.snapshots())


@query("select run_id, provider_id, started_at, row_number() over (partition by provider_id order by started_at desc, run_id desc) rn from runs where status in ('completed', 'partial')")
def runs_ranked(t: Tables) -> DataFrame:
    return runs.ranked(t.runs()).withColumn("rn", F.col("rn").cast("long"))


@query("""select post_id, coalesce(min_by(client, rank), 'unattributed') client from posts p left join (select account_id, cast(client_id as varchar) client, row_number() over (partition by account_id order by valid_from) rank, valid_from, valid_to from ownership where client_id % 3 <> 0) o
    on o.account_id = p.account_id and published_at >= valid_from and (published_at < valid_to or valid_to is null) group by post_id""")
def asof_first_match(t: Tables) -> DataFrame:
    a = t.ownership().where(F.pmod("client_id", F.lit(3)) != 0)
    a = a.select("account_id", F.col("client_id").cast("string").alias("client"), "valid_from", "valid_to", F.row_number().over(W.partitionBy("account_id").orderBy("valid_from")).alias("ord"))
    return metrics.first_owner(t.posts(), a)


# --- scalar functions -------------------------------------------------------------------

CANON, HANDLE = r"(?i)(?:https?://)?(?:www\.)?tiktok\.com/@[\w.]+/video/(\d+)", r"@([\w.]+)"
SHARE = r"(?i)^(?:https?://)?(?:vm|vt)\.tiktok\.com/\w+/?"
URLS = "urls as (select url from pages union all select url from vendor_posts)"


@query(f"""with {URLS} select url, nullif(regexp_extract(url, '{CANON}', 1), '') video_id, regexp_matches(trim(url), '{SHARE}') is_share,
    case when regexp_matches(url, '{CANON}') then 'canonical' when regexp_matches(trim(url), '{SHARE}') then 'share' else 'unknown' end kind from urls""")
def url_classify(t: Tables) -> DataFrame:
    urls = t.raw("pages").select("url").unionByName(t.vendor_posts().select("url"))
    return urls.select("url", X.video_id(F.col("url")).alias("video_id"), X.is_share_url(F.col("url")).alias("is_share"), X.url_kind(F.col("url")).alias("kind"))


@query(f"""with {URLS} select url, case when regexp_matches(url, '{CANON}') then 'https://www.tiktok.com/@' || regexp_extract(url, '{HANDLE}', 1) || '/video/' || regexp_extract(url, '{CANON}', 1) end canonical_url from urls""")
def url_canonical(t: Tables) -> DataFrame:
    urls = t.raw("pages").select("url").unionByName(t.vendor_posts().select("url"))
    return urls.select("url", X.canonical_url(F.col("url")).alias("canonical_url"))


@query(r"select vendor, ord, regexp_replace(caption, '\s+$', '') like '%...' is_truncated from vendor_posts")
def caption_truncated(t: Tables) -> DataFrame:
    return t.vendor_posts().select("vendor", "ord", X.is_truncated(F.col("caption")).alias("is_truncated"))


@query("select share_ord, vendor, candidate_ord from within_reach")
def caption_candidates(t: Tables) -> DataFrame:
    p = reconcile.classified(t.vendor_posts())
    return reconcile.candidates(p).select("share_ord", "vendor", "candidate_ord")


@query("""select c_custkey, coalesce(try_cast(regexp_extract(c_phone, '^(\\d+)', 1) as integer), 0) major, regexp_extract(c_phone, '^(\\d+)', 1) <> '' and cast(regexp_extract(c_phone, '^(\\d+)', 1) as integer) >= 20 at_least_20 from
    (select c_custkey, cast(10 + c_nationkey as varchar) || '-' || c_custkey c_phone from customer)""")
def version_range(t: Tables) -> DataFrame:
    v = F.concat((F.col("c_nationkey") + 10).cast("string"), F.lit("-"), F.col("c_custkey").cast("string"))
    return t.raw("customer").select("c_custkey", X.version_numbers(v)[0].cast("int").alias("major"), (X.version_key(v) >= X.version_key(F.lit("20"))).alias("at_least_20"))


@query("""with v as (select c_custkey, cast('20240101123456' || lpad(cast(c_custkey as varchar), 12, '0') as hugeint) first, c_custkey * 1000003 % 90000000000 mid from customer)
    select c_custkey, first > 20240101123456000000000700 or (first = 20240101123456000000000700 and mid >= 700002100) "at_least", cast(case when c_custkey % 3 = 0 then 2400 + c_custkey % 7 end as integer) height from v""")
def long_versions(t: Tables) -> DataFrame:
    """Versions of dates and times, and screen sizes that no int holds."""
    k = F.col("c_custkey")
    digits = F.concat(F.lit("0020240101123456"), F.lpad(k.cast("string"), 12, "0"))
    v = F.concat_ws(".", digits, F.concat(F.pmod(k * 1000003, F.lit(90000000000)).cast("string"), F.lit("-beta")))
    size = F.concat(F.lit("Physical size: 1080x"), F.when(F.pmod(k, F.lit(3)) == 0, (F.pmod(k, F.lit(7)) + 2400).cast("string")).otherwise(F.lit("99999999999")))
    return t.raw("customer").select("c_custkey", (X.version_key(v) >= X.version_key(F.lit("20240101123456000000000700.700002100"))).alias("at_least"), X.screen_size(size)["height"].alias("height"))


@query('select event_id, least(pow(2, event_id % 8), 30.0) "seconds" from events')
def backoff(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", X.backoff_seconds(F.pmod("event_id", F.lit(8)), F.lit(0.0)).alias("seconds"))


# --- vendor merge ---------------------------------------------------------------------------

EVENTS = "select user_id, max_by(\"value\", event_id) \"value\", max_by(event_id, event_id) event_id from events where event_type = '{}' group by user_id"


def _vendors(t: Tables) -> tuple[DataFrame, DataFrame]:
    e = t.raw("events").select("user_id", "event_id", "value", "event_type")
    return tuple(merge.last_rows(e.where(F.col("event_type") == k), "user_id", "event_id", ["value", "event_id"]) for k in ("view", "click"))


@query(f"select user_id, greatest(a.value, b.value) \"value\", greatest(a.event_id, b.event_id) event_id from ({EVENTS.format('view')}) a full join ({EVENTS.format('click')}) b using (user_id)")
def vendor_merge_max(t: Tables) -> DataFrame:
    return merge.in_key_order(merge.merged_max(*_vendors(t), "user_id", ["value", "event_id"]), "user_id")


@query(f"select user_id, case when b.event_id is not null then b.value else a.value end \"value\", coalesce(b.event_id, a.event_id) event_id from ({EVENTS.format('view')}) a full join ({EVENTS.format('click')}) b using (user_id)")
def vendor_merge_latest(t: Tables) -> DataFrame:
    return merge.merged_latest(*_vendors(t), "user_id", ["value", "event_id"], 1.0, 2.0)


@query(f"select count(*) filter (b.event_id is null) only_in_a, count(*) filter (a.event_id is null) only_in_b, count(*) filter (a.event_id is not null and b.event_id is not null) overlap_count from ({EVENTS.format('view')}) a full join ({EVENTS.format('click')}) b using (user_id)")
def vendor_overlap(t: Tables) -> DataFrame:
    return merge.overlap(*_vendors(t), "user_id")


@query(f"select user_id from events where event_type = 'view' union select user_id from events where event_type = 'click'")
def vendor_ids_union(t: Tables) -> DataFrame:
    a, b = _vendors(t)
    return a.select("user_id").union(b.select("user_id")).distinct()


@query("select post_id from posts except select post_id from snapshots")
def vendor_ids_difference(t: Tables) -> DataFrame:
    """Ids of one list that the other lacks: posts that were never scraped."""
    return t.posts().select("post_id").subtract(t.snapshots().select("post_id"))


@query(f"select user_id from events where event_type = 'view' intersect select user_id from events where event_type = 'click'")
def vendor_ids_intersection(t: Tables) -> DataFrame:
    e = t.raw("events")
    return e.where("event_type = 'view'").select("user_id").intersect(e.where("event_type = 'click'").select("user_id"))


# --- failures and pauses ----------------------------------------------------------------------

STREAKS = """islands as (select *, sum(case when failed then 0 else 1 end) over (partition by account_id order by ord) island from jobs),
    streaks as (select account_id, ord, failed, cast(sum(failed::int) over (partition by account_id, island order by ord) as bigint) consecutive_failures from islands),
    flags as (select *, max(consecutive_failures >= 3) over (partition by account_id order by ord) flagged from streaks)"""


@query(f"with {STREAKS} select * from flags")
def failure_streaks(t: Tables) -> DataFrame:
    return health.streaks(t.jobs())


@query(f"with {STREAKS} select account_id, max(flagged) flagged, max(consecutive_failures) longest_streak from flags group by account_id")
def failure_flags(t: Tables) -> DataFrame:
    return health.flagged_accounts(t.jobs())


@query(f"with {STREAKS} select account_id, ord, failed, coalesce(max(flagged) over (partition by account_id order by ord rows between unbounded preceding and 1 preceding), false) skipped from flags")
def failure_skips(t: Tables) -> DataFrame:
    return health.skipped(t.jobs())


@query("""with cleared as (select account_id, ord, failed, 0 clear from jobs union all select distinct account_id, 5000 + account_id, null, 1 from jobs),
    epochs as (select *, sum(clear) over (partition by account_id order by ord, clear desc) epoch from cleared),
    islands as (select *, sum(case when failed then 0 else 1 end) over (partition by account_id, epoch order by ord) island from epochs where clear = 0),
    streaks as (select *, cast(sum(failed::int) over (partition by account_id, epoch, island order by ord) as bigint) consecutive_failures from islands),
    flags as (select *, max(consecutive_failures >= 3) over (partition by account_id, epoch order by ord) flagged from streaks)
    select account_id, ord, failed, consecutive_failures, flagged, coalesce(max(flagged) over (partition by account_id, epoch order by ord rows between unbounded preceding and 1 preceding), false) skipped from flags""")
def failure_unflagged(t: Tables) -> DataFrame:
    """Streaks where every account is unflagged by hand once."""
    jobs = t.jobs()
    return health.streaks(jobs, jobs.select("account_id").distinct().select("account_id", (F.col("account_id") + 5000).alias("ord")))


BATCH = """b as (select *, account_id % 40 batch from jobs), c as (select *, count(*) over (partition by batch order by ord) done, count(*) filter (failed) over (partition by batch order by ord) bad, count(*) over (partition by batch) total from b),
    stop as (select batch, min(ord) pause_ord from c where failed and done >= greatest(5, floor(total * 0.1)) and bad / done > 0.2 group by batch)"""


@query(f"with {BATCH} select batch, pause_ord from stop")
def batch_pause(t: Tables) -> DataFrame:
    return health.paused(t.jobs().withColumn("batch", F.pmod("account_id", F.lit(40))))


@query(f"with {BATCH} select b.* from b left join stop using (batch) where pause_ord is null or ord <= pause_ord")
def batch_attempted(t: Tables) -> DataFrame:
    return health.attempted(t.jobs().withColumn("batch", F.pmod("account_id", F.lit(40)))).select("account_id", "ord", "failed", "batch")


SKIPPING = f"""{STREAKS}, jumped as (select account_id, ord, failed, coalesce(max(flagged) over (partition by account_id order by ord rows between unbounded preceding and 1 preceding), false) skipped, account_id % 40 batch from flags),
    c as (select *, count(*) filter (not skipped) over (partition by batch order by ord) done, count(*) filter (failed and not skipped) over (partition by batch order by ord) bad, count(*) over (partition by batch) total from jumped),
    hits as (select * from c where failed and not skipped and done >= greatest(5, floor(total * 0.1)) and bad / done > 0.2)"""


@query(f"with {SKIPPING} select batch, min(ord) pause_ord, arg_min(bad, ord) failed, arg_min(done, ord) completed, 'batch ' || batch || ' paused: ' || arg_min(bad, ord) || ' of ' || arg_min(done, ord) || ' jobs failed (' || cast(round(100 * arg_min(bad, ord) / arg_min(done, ord)) as bigint) || '%)' message from hits group by batch")
def batch_alerts(t: Tables) -> DataFrame:
    """Pauses where jobs of flagged accounts are skipped and count neither way."""
    return health.alerts(health.skipped(t.jobs()).withColumn("batch", F.pmod("account_id", F.lit(40))))


OUTCOMES = ["rate_limited", "timeout", "complete", "unavailable", "partial", "refused", "timeout"]


@query(f"""with tried as (select user_id job_id, row_number() over (partition by user_id order by event_id) attempt, ['{"', '".join(OUTCOMES)}'][event_id % {len(OUTCOMES)} + 1] outcome, case when event_id % 3 = 0 then event_id % 50 end retry_after from events),
    ends as (select job_id, min(attempt) filter (outcome in ('complete', 'refused')) final from tried where attempt <= 4 group by job_id),
    made as (select t.* from tried t join ends using (job_id) where attempt <= coalesce(final, 4))
    select job_id, case arg_max(outcome, attempt) when 'complete' then 'accepted' when 'refused' then 'raised' else 'exhausted' end status, count(*) attempts,
    coalesce(sum(case when outcome = 'rate_limited' and retry_after is not null then retry_after else least(pow(2, attempt - 1), 30) end) filter (attempt < 4 and outcome not in ('complete', 'refused')), 0.0)::double waited from made group by job_id""")
def retried_calls(t: Tables) -> DataFrame:
    e, n = t.raw("events"), F.lit(len(OUTCOMES))
    after = F.when(F.pmod("event_id", F.lit(3)) == 0, F.pmod("event_id", F.lit(50)).cast("double"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long")
    return health.retried(e.select(F.col("user_id").alias("job_id"), nth.alias("attempt"), F.array(*[F.lit(o) for o in OUTCOMES])[F.pmod("event_id", n).cast("int")].alias("outcome"), after.alias("retry_after"), F.lit(0.0).alias("jitter")))


@query("select event_id job_id, case when event_id % 17 <> 0 then (event_id % 4000) / 4 end elapsed, coalesce(event_id % 17 <> 0 and 0.25 * (event_id % 4000) > 600, false) timed_out from events")
def job_timeouts(t: Tables) -> DataFrame:
    """Jobs that start with an event and take up to 1,000 seconds; some never end."""
    end = F.when(F.pmod("event_id", F.lit(17)) != 0, F.col("ts") + F.make_dt_interval(secs=F.pmod("event_id", F.lit(4000)) / 4))
    return health.timed(t.raw("events").select(F.col("event_id").alias("job_id"), F.col("ts").alias("started_at"), end.alias("finished_at"))).select("job_id", "elapsed", "timed_out")


@query("select user_id job_id, min(attempt) attempt from (select user_id, row_number() over (partition by user_id order by event_id) attempt, event_type = 'purchase' is_complete from events) where attempt <= 4 and is_complete group by user_id")
def accepted_attempts(t: Tables) -> DataFrame:
    e = t.raw("events").select(F.col("user_id").alias("job_id"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).cast("long").alias("attempt"), (F.col("event_type") == "purchase").alias("is_complete"))
    return health.accepted_attempt(e)


# --- rollout ------------------------------------------------------------------------------------

PLAN = """ok as (select device_id, \"version\" from devices where \"connection\" not in ('offline', 'flaky') and task is null),
    firsts as (select min(device_id) device_id from ok where \"version\" in (8, 9, 10, 11) group by \"version\"),
    rest as (select device_id, row_number() over (order by device_id) - 1 r from ok where device_id not in (select device_id from firsts)),
    waves as (select device_id, 1 wave from firsts union all select device_id, case when r <= 0 then 1 else 2 + cast(floor(log2((r - 1) // 20 + 1) + 1e-12) as bigint) end from rest)"""


@query(f"with {PLAN} select device_id, cast(wave as bigint) wave from waves where (select count(*) from firsts) = 4")
def wave_plan(t: Tables) -> DataFrame:
    return rollout.plan(t.devices())


RECORDS = "records as (select device_id, case device_id % 9 when 0 then 'failed' when 1 then 'interrupted' when 2 then 'rolled_back' else 'succeeded' end status, device_id % 6 + 1 wave from devices)"


def _records(t: Tables) -> DataFrame:
    k = F.pmod("device_id", F.lit(9))
    status = F.when(k == 0, "failed").when(k == 1, "interrupted").when(k == 2, "rolled_back").otherwise("succeeded")
    return t.devices().select("device_id", status.alias("status"), (F.pmod("device_id", F.lit(6)) + 1).alias("wave"))


@query(f"""with {RECORDS} select wave, coalesce(count(*) filter (status = 'failed') / nullif(count(*) filter (status <> 'interrupted'), 0), 0.0) failure_rate,
    case when wave = 1 then bool_or(status = 'failed') else coalesce(count(*) filter (status = 'failed') / nullif(count(*) filter (status <> 'interrupted'), 0), 0.0) > 0.02 end halts from records group by wave""")
def wave_failure_rate(t: Tables) -> DataFrame:
    return rollout.gates(_records(t))


@query("with " + RECORDS + " select " + ", ".join(f"count(*) filter (status = '{s}') {s}" for s in rollout.LABELS) + " from records")
def status_histogram(t: Tables) -> DataFrame:
    return rollout.histogram(_records(t))


OUTCOME = """outcomes as (select device_id, case when device_id > 100 and device_id % 29 = 20 then 'failed' when device_id % 19 = 1 then 'interrupted' else 'succeeded' end status, device_id % 7 <> 2 has_snapshot, device_id % 5 <> 1 restored_ok from devices)"""
COURSE = f"""{PLAN}, {OUTCOME}, planned as (select w.device_id, wave, status, has_snapshot, restored_ok from waves w join outcomes using (device_id) where (select count(*) from firsts) = 4),
    rates as (select wave, coalesce(count(*) filter (status = 'failed') / nullif(count(*) filter (status <> 'interrupted'), 0), 0.0) failure_rate, bool_or(status = 'failed') any_failed from planned group by wave),
    stop as (select min(wave) stop from rates where case when wave = 1 then any_failed else failure_rate > 0.02 end)"""


def _course(t: Tables) -> tuple[DataFrame, DataFrame]:
    d = t.devices()
    left = lambda k: F.pmod("device_id", F.lit(k))
    outcomes = d.select("device_id", F.when((F.col("device_id") > 100) & (left(29) == 20), "failed").when(left(19) == 1, "interrupted").otherwise("succeeded").alias("status"), (left(7) != 2).alias("has_snapshot"), (left(5) != 1).alias("restored_ok"))
    return rollout.course(rollout.plan(d), outcomes)


@query(f"""with {COURSE} select device_id, wave, case when wave = stop and status in ('succeeded', 'failed') and has_snapshot and restored_ok then 'rolled_back' else status end status,
    case when wave = stop and status in ('succeeded', 'failed') then case when not has_snapshot then 'rollback: no snapshot' when not restored_ok then 'rollback: not restored' end end error from planned cross join stop where stop is null or wave <= stop""")
def rollout_records(t: Tables) -> DataFrame:
    return _course(t)[0]


@query(f"with {COURSE} select wave, case when stop is null or wave < stop then 'completed' when wave = stop then 'failed' else 'halted' end status, case when stop is null or wave <= stop then failure_rate end failure_rate from rates cross join stop")
def rollout_waves(t: Tables) -> DataFrame:
    return _course(t)[1]


TRIES = "tries as (select user_id device_id, row_number() over (partition by user_id order by event_id) attempt, ['disconnected', 'disconnected', 'disconnected', 'succeeded', 'failed'][(event_id * 3 + user_id) % 5 + 1] result from events)"


@query(f"with {TRIES} select device_id, coalesce(arg_min(result, attempt) filter (result <> 'disconnected'), 'interrupted') status from tries where attempt <= 4 group by device_id")
def disconnect_outcomes(t: Tables) -> DataFrame:
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    result = F.array(*[F.lit(x) for x in ("disconnected", "disconnected", "disconnected", "succeeded", "failed")])[F.pmod(F.col("event_id") * 3 + F.col("user_id"), F.lit(5)).cast("int")]
    return rollout.outcome(t.raw("events").select(F.col("user_id").alias("device_id"), nth.alias("attempt"), result.alias("result")))


@query(f"with {RECORDS} select device_id, case status " + " ".join(f"when '{s}' then '{v}'" for s, v in rollout.LABELS.items()) + " end label from records")
def status_labels(t: Tables) -> DataFrame:
    return _records(t).select("device_id", rollout.label(F.col("status")).alias("label"))


@query("""with roll as (select i, ('0x' || substr(md5('1:connection:' || i), 1, 8))::bigint % 1000 roll, ('0x' || substr(md5('1:busy:' || i), 1, 8))::bigint % 1000 busy, ('0x' || substr(md5('1:version:' || i), 1, 8))::bigint % 4 v,
        ('0x' || substr(md5('1:task:' || i), 1, 8))::bigint % 9000 task, ('0x' || substr(md5('1:heartbeat:' || i), 1, 8))::bigint % 301 beat from (select c_custkey + 1 i from customer))
    select 'device-' || lpad(i::varchar, greatest(3, length(i::varchar))::integer, '0') device_id, case when i <= 4 then i + 7 else v + 8 end "version", case when i > 4 and roll >= 150 and busy < 80 then 'task-' || (task + 1000) end task,
        case when i <= 4 then 'good' when roll < 50 then 'offline' when roll < 150 then 'flaky' else 'good' end "connection", timestamp '2025-01-01' - to_seconds(beat) last_heartbeat from roll""")
def mock_fleet(t: Tables) -> DataFrame:
    """A device for each customer."""
    return fleet.devices(t.raw("customer").select((F.col("c_custkey") + 1).cast("long").alias("id")))


# --- state logs -----------------------------------------------------------------------------------

EVENT_MOVES = {"view": ["click", "error"], "click": ["view", "purchase", "error"], "purchase": ["view"], "error": ["view"]}


@query("with moves as (select *, lag(state) over (partition by \"session\" order by ord) was from states) select \"session\", ord, was, state, (was, state) in (" + ", ".join(f"('{a}', '{b}')" for a, to in EVENT_MOVES.items() for b in to) + ") \"valid\" from moves where was is not null")
def transition_audit(t: Tables) -> DataFrame:
    return uilog.audit(t.states(), EVENT_MOVES)


def _moves(table: dict[str, list[str]]) -> str:
    return ", ".join(f"('{a}', '{b}')" for a, to in table.items() for b in to)


SCREENS = list(uilog.TRANSITIONS)


@query(f"""with shown as (select user_id "session", event_id ord, ['{"', '".join(SCREENS)}'][(event_id * 7 + user_id * 3 + event_id // 11) % {len(SCREENS)} + 1] state from events),
    moves as (select *, lag(state) over (partition by "session" order by ord) was from shown)
    select "session", ord, was, state, (was, state) in ({_moves(uilog.TRANSITIONS)}) "valid" from moves where was is not null""")
def screen_audit(t: Tables) -> DataFrame:
    nth = F.pmod(F.col("event_id") * 7 + F.col("user_id") * 3 + F.floor(F.col("event_id") / 11), F.lit(len(SCREENS)))
    shown = t.raw("events").select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("ord"), F.array(*[F.lit(s) for s in SCREENS])[nth.cast("int")].alias("state"))
    return uilog.audit(shown)


# --- reconciliation -------------------------------------------------------------------------------


@query("select id post_id, greatest(coalesce(max(views) filter (vendor = 'A'), 0), coalesce(max(views) filter (vendor = 'B'), 0)) views from vendor_posts where id is not null and not contains(url, 'vm.') group by id")
def metric_resolve(t: Tables) -> DataFrame:
    p = t.vendor_posts().where("id is not null and not contains(url, 'vm.')")
    side = p.groupBy(F.col("id").alias("post_id")).agg(F.max(F.when(F.col("vendor") == "A", F.col("views"))).alias("a"), F.max(F.when(F.col("vendor") == "B", F.col("views"))).alias("b"))
    return side.select("post_id", X.resolved_metric(F.col("a"), F.col("b")).alias("views"))


#: The walk takes the shared rows of each account in their order, with the ids taken so far.
RECONCILED = """recursive lined as (select account, share_vendor, share_ord, row_number() over (partition by account order by share_turn) k, cands from (select account, share_vendor, share_ord, share_turn, list(candidate) cands from within_reach group by all)),
    walk as (select account, 0::bigint k, []::varchar[] taken, null::varchar share_vendor, null::bigint share_ord, null::varchar candidate from (select distinct account from lined)
        union all select account, k, case when len(free) = 1 then list_append(taken, free[1]) else taken end, share_vendor, share_ord, case when len(free) = 1 then free[1] end
        from (select l.account, l.k, w.taken, l.share_vendor, l.share_ord, [c for c in l.cands if not list_contains(w.taken, c)] free from walk w join lined l on l.account = w.account and l.k = w.k + 1)),
    matched as (select share_vendor vendor, share_ord ord, candidate from walk where candidate is not null),
    met as (select c.*, m.candidate from classified c left join matched m using (vendor, ord) where shared),
    grouped as (select coalesce(vid, given) post_id, turn place, * from classified where not shared union all by name select candidate post_id, 100000000000000 + turn place, * exclude (candidate) from met where candidate is not null),
    firsts as (select post_id, arg_min(views, place) filter (vendor = 'A') a_views, arg_min(views, place) filter (vendor = 'B') b_views, arg_min(likes, place) filter (vendor = 'A') a_likes, arg_min(likes, place) filter (vendor = 'B') b_likes,
        arg_min(comments, place) filter (vendor = 'A') a_comments, arg_min(comments, place) filter (vendor = 'B') b_comments, arg_min(posted_at, place) posted_at, arg_min(account, place) account,
        first(caption order by cut, length(caption) desc, place) caption, list_sort(list_distinct(list(url))) raw_urls, list(caption order by place) filter (cut) cuts, bool_or(not cut) any_whole,
        arg_min('https://www.tiktok.com/@' || regexp_extract(url, '@([\\w.]+)', 1) || '/video/' || vid, place) filter (kind = 'canonical') canonical_url from grouped group by post_id),
    last_seen as (select id, arg_max(views, ord) s_views, arg_max(likes, ord) s_likes from previous_posts group by id),
    resolved as (select *, coalesce(greatest(a_views, b_views, s_views), 0) views, coalesce(greatest(a_likes, b_likes, s_likes), 0) likes, coalesce(greatest(a_comments, b_comments), 0) comments from firsts left join last_seen on id = post_id),
    vanished as (select p.id, l.s_views, l.s_likes from previous_posts p join last_seen l using (id) where p.id not in (select post_id from grouped))"""
OWNER = "coalesce((select arg_min(client, o.ord) from assignments o where o.account = {0}.account and {0}.posted_at >= valid_from and ({0}.posted_at < valid_to or valid_to is null)), 'unattributed')"


@query(f"""with {RECONCILED} select post_id, canonical_url, 'active' status, views, likes, comments, caption, posted_at, account, {OWNER.format('r')} client, array_to_string(raw_urls, ' ') raw_urls, a_views, b_views, s_views from resolved r
    union all select null, null, 'unresolved', views, likes, comments, caption, posted_at, account, {OWNER.format('m')}, url, null, null, null from met m where url in (select url from met where candidate is null)
    union all select id, null, 'missing', s_views, s_likes, 0, '', timestamp '2023-12-31', '', 'unknown', '', null, null, null from vanished""")
def reconcile_posts(t: Tables) -> DataFrame:
    traced = [F.get(F.filter("provenance", lambda p: p["metric"] == "views"), F.lit(0))[c].alias(f"{n}_views") for n, c in (("a", "provider_a"), ("b", "provider_b"), ("s", "snapshot"))]
    return _report(t).posts.select("*", *traced).withColumn("raw_urls", F.array_join("raw_urls", " ")).drop("provenance")


@query(f"""with {RECONCILED}, facts as (select post_id, 'views' metric, a_views a, b_views b, s_views s, views high from resolved union all select post_id, 'likes', a_likes, b_likes, s_likes, likes from resolved union all select post_id, 'comments', a_comments, b_comments, null, comments from resolved)
    select 'metric_conflict' kind, post_id, cast(json_object('metric', metric, 'provider_a', a, 'provider_b', b, 'resolved_value', high) as varchar) details from facts where a <> b
    union all select 'view_decrease', post_id, cast(json_object('metric', metric, 'source', source, 'current_value', v, 'snapshot_value', s, 'resolved_value', high) as varchar) from (select *, 'provider_a' source, a v from facts union all select *, 'provider_b', b from facts) where v < s
    union all select 'caption_truncation_match', post_id, cast(json_object('truncated_captions', cuts, 'full_caption', caption) as varchar) from resolved where len(cuts) > 0 and any_whole
    union all select 'unresolved_share_url', candidate, cast(case when candidate is null then json_object('share_url', url, 'account', account) else json_object('share_url', url, 'matched_video_id', candidate, 'matching_signals', ['account', 'timestamp', 'caption_similarity']) end as varchar) from met
    union all select 'disappeared_post', id, cast(json_object('last_views', s_views, 'last_likes', s_likes, 'last_scraped_at', '2023-12-31T00:00:00Z', 'last_source', 'A') as varchar) from vanished
    union all select 'possible_outage', null, cast(json_object('missing', count(*)) as varchar) from vanished having count(*) >= 3""")
def reconcile_anomalies(t: Tables) -> DataFrame:
    return _report(t).anomalies


@query(f"with {RECONCILED} select url from met where candidate is null")
def reconcile_unresolved(t: Tables) -> DataFrame:
    return _report(t).unresolved


@query(f"with {RECONCILED} select vendor, ord, candidate from matched")
def share_matches(t: Tables) -> DataFrame:
    m = reconcile.matches(reconcile.classified(t.vendor_posts()))
    return m.select(F.col("share_vendor").alias("vendor"), F.col("share_ord").alias("ord"), "candidate")


#: One walk over all shared rows, whatever their account.
@query("""with recursive lined as (select share_vendor, share_ord, row_number() over (order by share_turn) k, cands from (select share_vendor, share_ord, share_turn, list(candidate) cands from syndicated_within_reach group by all)),
    walk as (select 0::bigint k, []::varchar[] taken, null::varchar share_vendor, null::bigint share_ord, null::varchar candidate
        union all select k, case when len(free) = 1 then list_append(taken, free[1]) else taken end, share_vendor, share_ord, case when len(free) = 1 then free[1] end
        from (select l.k, w.taken, l.share_vendor, l.share_ord, [c for c in l.cands if not list_contains(w.taken, c)] free from walk w join lined l on l.k = w.k + 1))
    select share_vendor vendor, share_ord ord, candidate from walk where candidate is not null""")
def share_matches_two_accounts(t: Tables) -> DataFrame:
    m = reconcile.matches(reconcile.classified(t.syndicated_posts()))
    return m.select(F.col("share_vendor").alias("vendor"), F.col("share_ord").alias("ord"), "candidate")


#: Every view is a post, and every purchase begins a period of its user, which lasts twenty days or until the next one.
PERIODS = """periods as (select user_id account_id, event_id client_id, ts valid_from, least(coalesce(lead(ts) over (partition by user_id order by ts, event_id), timestamp '9999-01-01'), ts + interval 20 day) valid_to from events where event_type = 'purchase')"""


@query(f"""with {PERIODS} select e.event_id post_id, p.client_id from events e join periods p on p.account_id = e.user_id and e.ts >= valid_from and e.ts < valid_to where event_type = 'view'""")
def owners_of_long_histories(t: Tables) -> DataFrame:
    """Every history is merged with its posts in order of time."""
    return asof.holding(_views(t), _bought(t), "account_id", "published_at", few=0).select("post_id", "client_id")


@query(f"""with {PERIODS}, longer as (select account_id, client_id, valid_from, valid_from + interval 1 hour * (client_id % 40) valid_to from periods where client_id % 40 > 0),
    swept as (select *, max(valid_to) over (partition by account_id order by valid_from, valid_to, client_id rows between unbounded preceding and 1 preceding) until from longer)
    select account_id, client_id, valid_from, valid_to, until from swept where until > valid_from""")
def ownership_overlaps(t: Tables) -> DataFrame:
    longer = _bought(t).where("client_id % 40 > 0").withColumn("valid_to", F.col("valid_from") + F.make_interval(hours=F.pmod("client_id", F.lit(40)).cast("int")))
    return asof.overlapping(longer)


#: Each order moves its account in the month of the order: many at once, many before the open period, many against each other.
CHANGES = """changes as (select o_custkey account_id, o_orderkey % 4 client_id, cast(date_trunc('month', o_orderdate) as timestamp) "at" from orders),
    held as (select * from ownership where account_id % 7 <> 0 and (account_id % 5 <> 0 or valid_to is not null)),
    now as (select account_id, max(valid_from) filter (valid_to is null) open_from, max(client_id) filter (valid_to is null) holder, max(valid_to) ended from held group by all),
    judged as (select c.account_id, "at", min(client_id) client_id, case when "at" <= any_value(open_from) or (any_value(open_from) is null and "at" < any_value(ended)) then 'late' when min(client_id) <> max(client_id) then 'contradictory' end why, any_value(holder) holder
        from changes c left join now n on n.account_id = c.account_id group by c.account_id, "at"),
    told as (select *, case when why is not null then why when coalesce(lag(client_id) over (partition by account_id, why is null order by "at"), holder) = client_id then 'unchanged' end reason from judged),
    good as (select *, lead("at") over (partition by account_id order by "at") until from told where reason is null)"""


@query(f"""with {CHANGES} select h.account_id, h.client_id, valid_from, coalesce(valid_to, (select min("at") from good g where g.account_id = h.account_id)) valid_to from held h
    union all select account_id, client_id, "at", until from good""")
def ownership_timeline(t: Tables) -> DataFrame:
    return ownership.merged(_held(t), _changes(t))[0]


@query(f"""with {CHANGES}, n as (select account_id, client_id, "at", count(*) n from changes group by all), why as (select n.*, reason from n join told using (account_id, "at"))
    select account_id, client_id, "at", reason, case when reason = 'unchanged' then 1 else n end n from why where reason is not null union all
    select account_id, client_id, "at", 'repeated', n - 1 from why where (reason is null or reason = 'unchanged') and n > 1""")
def ownership_refused(t: Tables) -> DataFrame:
    return ownership.merged(_held(t), _changes(t))[1]


def _changes(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_custkey").alias("account_id"), F.pmod("o_orderkey", F.lit(4)).cast("long").alias("client_id"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("at"))


def _held(t: Tables) -> DataFrame:
    """Some accounts have no owner yet, some none any more."""
    return t.ownership().where("account_id % 7 <> 0 and (account_id % 5 <> 0 or valid_to is not null)")


def _views(t: Tables) -> DataFrame:
    return t.raw("events").where("event_type = 'view'").select(F.col("event_id").alias("post_id"), F.col("user_id").alias("account_id"), F.col("ts").alias("published_at"))


def _bought(t: Tables) -> DataFrame:
    bought = t.raw("events").where("event_type = 'purchase'").select(F.col("user_id").alias("account_id"), F.col("event_id").alias("client_id"), F.col("ts").alias("valid_from"))
    following = F.lead("valid_from").over(W.partitionBy("account_id").orderBy("valid_from", "client_id"))
    return bought.withColumn("valid_to", F.least(following, F.col("valid_from") + F.expr("interval 20 day")))


def _report(t: Tables) -> reconcile.Report:
    return reconcile.reconciled(t.vendor_posts(), t.previous_posts(), t.assignments())


def _missing(t: Tables) -> DataFrame:
    p = reconcile.classified(t.vendor_posts())
    return reconcile.missing(p, t.previous_posts(), reconcile.matches(p))


@query(f"with {RECONCILED} select id, s_views latest_seen from vanished")
def disappeared_posts(t: Tables) -> DataFrame:
    return _missing(t).select("id", F.col("views").alias("latest_seen"))


@query(f"with {RECONCILED} select count(*) missing, count(*) >= 3 outage from vanished")
def outage_flag(t: Tables) -> DataFrame:
    return _missing(t).agg(F.count("*").alias("missing"), (F.count("*") >= reconcile.OUTAGE).alias("outage"))


# --- replayed streams ----------------------------------------------------------------------------

PARTS = 4
#: Events come in four parts by their number; some come one or two parts too late.
ARRIVED = """bounds as (select min(event_id) low, max(event_id) + 1 - min(event_id) n from events),
    arrived as (select event_id, ts, user_id, event_type, least(3, cast(floor((event_id - low) * 4 / n) as integer) + (event_id % 20 = 7)::integer + 2 * (event_id % 40 = 9)::integer) part from events, bounds),
    marks as (select p.part, (select max(ts) from arrived a where a.part <= p.part) - interval 1 day mark from range(0, 4) p(part))"""


def _arrived(t: Tables) -> DataFrame:
    events = t.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    by = F.floor((F.col("event_id") - low) * PARTS / (high + 1 - low)).cast("int")
    late = F.when(F.pmod("event_id", F.lit(20)) == 7, 1).otherwise(0) + F.when(F.pmod("event_id", F.lit(40)) == 9, 2).otherwise(0)
    return events.select("event_id", "ts", "user_id", "event_type", "value", F.least(F.lit(PARTS - 1), by + late).alias("part"))


@query(f"""with {ARRIVED}, spans as (select a.*, "start", "start" + interval 6 hour "end" from (select *, unnest([time_bucket(interval 3 hour, ts), time_bucket(interval 3 hour, ts) - interval 3 hour]) "start" from arrived) a),
    kept as (select s.*, coalesce("end" > mark, true) counts from spans s left join marks m on m.part = s.part - 1)
    select "start", "end", event_type, count(*) filter (counts) n, count(*) filter (not counts) lost from kept where "end" <= (select max(mark) from marks) group by all""")
def stream_windows(t: Tables) -> DataFrame:
    """Sliding windows of a stream that is restarted three times, and what each lost by its watermark."""
    rows = _arrived(t)
    counted = lambda df: monitor.windowed_counts(df, "6 hours", "3 hours", "1 day")
    closed = replay.replayed(rows, F.col("part"), PARTS, counted)
    upto = rows.agg(F.max("ts")).first()[0]
    whole = counted(rows).select("start", "end", "event_type", "n")
    out = replay.with_lost(closed, whole, ["start", "end", "event_type"], F.lit(upto) - F.expr("interval 1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "lost")


@query(f"""with {ARRIVED}, marked as (select *, coalesce(ts - lag(ts) over w >= interval 4 hour, true) fresh from arrived window w as (partition by user_id order by ts)),
    numbered as (select *, sum(fresh::integer) over (partition by user_id order by ts rows unbounded preceding) nth from marked),
    found as (select user_id, min(ts) "start", max(ts) + interval 4 hour "end", count(*) n from numbered group by user_id, nth)
    select "start", "end", user_id, n from found where "end" <= (select max(ts) from arrived) - interval 20 day""")
def stream_sessions(t: Tables) -> DataFrame:
    """Sessions across restarts, with a watermark that waits for the latest of the late rows."""
    out = replay.replayed(_arrived(t), F.col("part"), PARTS, lambda df: monitor.sessions(df, "4 hours", "20 days"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


#: Errors are failures, purchases unflag; a day without events starts a new streak. The stream goes on after the first part.
WATCHED = f"""{ARRIVED}, ordered as (select event_id, ts, user_id, event_type = 'error' failed, event_type = 'purchase' clear, cast(floor((event_id - low) * 4 / n) as integer) part from events, bounds),
    gaps as (select *, coalesce(ts - lag(ts) over (partition by user_id order by event_id) > interval 1 day, false) quiet from ordered),
    epochs as (select *, sum(clear::integer) over (partition by user_id order by event_id) epoch from gaps),
    islands as (select *, sum(case when failed and not quiet then 0 else 1 end) over (partition by user_id, epoch order by event_id) island from epochs),
    streaks as (select *, cast(sum(failed::integer) over (partition by user_id, epoch, island order by event_id) as bigint) consecutive_failures from islands where not clear),
    flags as (select *, max(consecutive_failures >= 3) over (partition by user_id, epoch order by event_id) flagged from streaks)"""


@query(f"""with {WATCHED}, out as (select *, coalesce(max(flagged) over (partition by user_id, epoch order by event_id rows between unbounded preceding and 1 preceding), false) skipped from flags)
    select user_id account_id, event_id ord, failed, consecutive_failures, flagged, skipped from out where part > 0""")
def stream_failures(t: Tables) -> DataFrame:
    """Streaks kept as state: begun from a table, unflagged by events, delivered twice, forgotten when quiet."""
    events = t.raw("events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    place = (F.col("event_id") - low) * PARTS / (high + 1 - low)
    rows = events.select(F.col("user_id").alias("account_id"), F.col("event_id").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"), (F.col("event_type") == "purchase").alias("clear"), F.floor(place).cast("int").alias("part"), (place - F.floor(place)).alias("within"))
    before = health.last_states(rows.where("part = 0"), "1 day")
    # a part brings the end of the one before once more
    again = rows.where(f"part between 1 and {PARTS - 2} and within > 0.98").withColumn("part", F.col("part") + 1)
    monitor.with_rocksdb(t.spark)
    rest = rows.where("part > 0").unionByName(again).drop("within")
    return replay.replayed(rest, F.col("part") - 1, PARTS - 1, lambda df: monitor.watched(df, before, "1 day", "30 days"))


# --- a store filled from the tables ---------------------------------------------------------------


def _store(t: Tables) -> store.RunStore:
    return store.RunStore(t.spark, f"{shared_folder(t.spark)}/store-{uuid.uuid4().hex}")


def _broken_publication(s: store.RunStore, run: int, rows: DataFrame) -> None:
    """Rows of a run whose writer ended before the run's last event."""
    s.event(run, "running", "2024-01-01 00:00:00", "lost")
    rows.withColumn("run_id", F.lit(run).cast("long")).withColumn("attempt", F.lit("lost")).write.mode("append").partitionBy("run_id", "attempt").parquet(f"{s.folder}/snapshots")


@query("select * from hwm")
def maintained_marks(t: Tables) -> DataFrame:
    """Marks as a view that three publications bring up to date, each by its own rows; one is tried twice."""
    s = _store(t)
    view = versions.MaintainedMarks(s)
    rows = t.snapshots().select("post_id", *metrics.METRICS, F.pmod(F.year("scraped_at"), F.lit(3)).alias("third"))
    for run in range(3):
        own = rows.where(F.col("third") == run).drop("third")
        if run == 1:
            _broken_publication(s, run, own.withColumn("views", F.col("views") + 10**9))
        s.publish(run, f"2024-01-0{run + 1} 00:00:00", snapshots=own)
        view.refresh()
    s.compact()
    return view.read()


@query("select event_type, count(*) n, cast(sum(event_id) as bigint) ids from events group by all")
def streamed_store(t: Tables) -> DataFrame:
    """Micro-batches published as runs; each is given twice, and one is written half before."""
    s = _store(t)
    sink = s.sink("snapshots", 1, "2024-01-01 00:00:00")
    rows = _arrived(t).select("event_id", "event_type", "part")
    folder = f"{s.folder}-in"

    def twice(batch: DataFrame, number: int) -> None:
        if number == 1:
            _broken_publication(s, 1 + number, batch)
        sink(batch, number)
        sink(batch, number)

    for part in range(PARTS):
        rows.where(F.col("part") == part).drop("part").write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema("event_id long, event_type string").parquet(f"{folder}/in")
        stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read("snapshots").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


# --- a recorded batch -----------------------------------------------------------------------------

#: Each event is a job; what its two vendors answer follows from its number.
RUN = """calls as (select event_id job_id, user_id account_id, event_id ord, user_id % 7 batch, 10.0 + event_id % 200 took, event_type = 'error' bad from events),
    ends as (select *, case when bad and job_id % 2 = 0 then took when bad then 4 * took + 7 when job_id % 5 = 1 then 2 * took + 5 when job_id % 5 = 2 then 3 * took + 3 else took end a,
        case when bad and job_id % 2 = 0 then 'raised' when bad then 'exhausted' end a_bad, case when job_id % 37 = 0 then 4 * took + 7 else took end b, case when job_id % 37 = 0 then 'exhausted' end b_bad from calls),
    fails as (select *, least(case when a_bad is not null then a end, case when b_bad is not null then b end) f, greatest(a, b) l from ends),
    called as (select *, case when f <= 600 then case when a_bad is not null and (b_bad is null or a < b or (a = b and a_bad <= b_bad)) then a_bad else b_bad end when l > 600 then 'timeout' end reason, case when f <= 600 then f else least(l, 600.0) end ended from fails),
    runs_ as (select *, sum((reason is null)::integer) over (partition by account_id order by ord) island from called),
    streak as (select *, sum((reason is not null)::integer) over (partition by account_id, island order by ord) run from runs_),
    skips as (select *, coalesce(max(run) over (partition by account_id order by ord rows between unbounded preceding and 1 preceding), 0) >= 3 skipped from streak),
    counted as (select *, count(*) filter (not skipped) over (partition by batch order by ord) done, count(*) filter (not skipped and reason is not null) over (partition by batch order by ord) failures, count(*) over (partition by batch) total from skips),
    stop as (select batch, min(ord) pause_ord from counted where not skipped and reason is not null and done >= greatest(5, floor(total * 0.1)) and failures / done > 0.2 group by batch),
    judged as (select c.*, case when ord > pause_ord then 'not_run' when skipped then 'skipped' when reason is not null then 'failure' else 'success' end outcome from counted c left join stop using (batch)),
    answers as (select job_id, account_id, ord, account_id * 10 + i post, job_id + i "views", 1 in_a, 0 in_b from (select *, unnest(range(0, job_id % 4)) i from judged where outcome = 'success') union all
        select job_id, account_id, ord, account_id * 10 + i, job_id + 2, 0, 1 from (select *, unnest(range(1, job_id % 3 + 1)) i from judged where outcome = 'success')),
    merged as (select job_id, account_id, ord, post, max("views") "views", max(in_a) in_a, max(in_b) in_b from answers group by all)"""


@query(f"""with {RUN}, n as (select job_id, sum(in_a) posts_a, sum(in_b) posts_b, count(*) reconciled, sum(in_a * in_b) overlap, count(*) filter (ord = first_ord) new_posts from (select *, min(ord) over (partition by account_id, post) first_ord from merged) group by job_id)
    select j.job_id, account_id, outcome, case when outcome = 'failure' then reason end reason, case when outcome in ('success', 'failure') then cast(ended as double) end ended, """ + ", ".join(f"case when outcome = 'success' then cast(coalesce({c}, 0) as bigint) end {c}" for c in ("posts_a", "posts_b", "reconciled", "overlap", "new_posts")) + " from judged j left join n using (job_id)")
def batch_results(t: Tables) -> DataFrame:
    return _batch(t)[0]


@query(f"""with {RUN} select job_id, cast(post as varchar) platform_post_id, "views" from merged""")
def batch_snapshots(t: Tables) -> DataFrame:
    return _batch(t)[1].select("job_id", "platform_post_id", "views")


def _batch(t: Tables) -> tuple[DataFrame, DataFrame]:
    n, rows = F.col("event_id"), t.raw("events")
    every = lambda k, r: F.pmod(n, F.lit(k)) == r
    said = lambda *names: F.array(*[F.lit(x) for x in names])
    bad = F.col("event_type") == "error"
    a = F.when(bad & every(2, 0), said("refused", "complete")).when(bad, said("timeout", "unavailable", "timeout", "partial", "complete")).when(every(5, 1), said("rate_limited", "complete")).when(every(5, 2), said("timeout", "partial", "complete", "complete")).otherwise(said("complete"))
    b = F.when(every(37, 0), said(*["unavailable"] * 4)).otherwise(said("complete"))
    calls = rows.select(n.alias("job_id"), F.inline(F.array(F.struct(F.lit("A").alias("vendor"), a.alias("said")), F.struct(F.lit("B").alias("vendor"), b.alias("said")))), (F.pmod(n, F.lit(200)) + 10.0).alias("took"))
    attempts = calls.select("job_id", "vendor", "took", F.posexplode("said").alias("at", "outcome")).withColumn("attempt", F.col("at") + 1)
    attempts = attempts.withColumn("retry_after", F.when(F.col("outcome") == "rate_limited", 5.0)).withColumn("jitter", F.lit(0.0))
    some = lambda vendor, low, high, add: rows.where(F.lit(low) < high).select(n.alias("job_id"), F.lit(vendor).alias("vendor"), F.col("user_id"), F.explode(F.sequence(F.lit(low).cast("long"), high - 1)).alias("i")).select("job_id", "vendor", (F.col("user_id") * 10 + F.col("i")).cast("string").alias("platform_post_id"), add.alias("views"), *[F.lit(0).cast("long").alias(m) for m in metrics.METRICS[1:]])
    posts = some("A", 0, F.pmod(n, F.lit(4)), F.col("job_id") + F.col("i")).unionByName(some("B", 1, F.pmod(n, F.lit(3)) + 1, F.col("job_id") + 2))
    jobs = rows.select(n.alias("job_id"), F.col("user_id").alias("account_id"), n.alias("ord"), F.pmod("user_id", F.lit(7)).alias("batch"))
    return batch.run(jobs, attempts, posts)


# --- recorded responses --------------------------------------------------------------------------


@query("""with r as (select user_id, event_id, case event_type when 'error' then 'timeout' when 'purchase' then 'rate_limited' when 'click' then 'partial' else 'complete' end outcome, event_id % 3 posts from events)
    select '@u' || user_id account, outcome, count(*) responses, cast(sum(case when outcome = 'complete' then posts else 0 end) as bigint) posts, cast(coalesce(sum(case when outcome = 'complete' and posts > 0 then event_id * posts + posts * (posts - 1) / 2 end), 0) as bigint) "views" from r group by all""")
def recorded_responses(t: Tables) -> DataFrame:
    """Every event as a vendor's response in JSON files, read back through the data source."""
    folder = f"{shared_folder(t.spark)}/recorded-{uuid.uuid4().hex}"
    n, kind = F.col("event_id"), F.col("event_type")
    post = lambda i: F.struct(F.concat(n.cast("string"), F.lit("-"), i.cast("string")).alias("platform_post_id"), (n + i).alias("views"))
    rows = t.raw("events").select(
        F.concat(F.lit("@u"), F.col("user_id").cast("string")).alias("account"), n.alias("job_id"), F.lit(1).alias("attempt"), F.lit("A").alias("vendor"), (kind != "click").alias("is_complete"),
        F.when(kind == "error", "timeout").when(kind == "purchase", "rate_limited").alias("outcome"), F.slice(F.array(post(F.lit(0)), post(F.lit(1)), post(F.lit(2))), F.lit(1), F.pmod(n, F.lit(3)).cast("int")).alias("posts"),
    )
    recorded.write(rows, folder)
    recorded.register(t.spark)
    read = t.spark.read.format("recorded_responses").option("path", folder).load()
    views = F.aggregate("posts", F.lit(0).cast("long"), lambda a, p: a + p["views"])
    return read.groupBy("account", "outcome").agg(F.count("*").alias("responses"), F.sum(F.size("posts")).alias("posts"), F.sum(views).alias("views"))


# --- integrity -----------------------------------------------------------------------------------


@query("""select 'negative_metric' rule, count(*) n from snapshots where views < 0 or likes < 0 or comments < 0 or shares < 0
    union all select 'orphan_snapshot', count(*) from snapshots where post_id not in (select post_id from posts)
    union all select 'two_open_owners', count(*) from (select account_id from ownership where valid_to is null group by account_id having count(*) > 1)
    union all select 'period_backwards', count(*) from ownership where valid_to <= valid_from
    union all select 'duplicate_post', count(*) from (select platform_post_id, provider_id from posts group by all having count(*) > 1)
    union all select 'bad_status', count(*) from runs where status not in ('running', 'completed', 'failed', 'partial')""")
def constraint_violations(t: Tables) -> DataFrame:
    return store.violations(t.snapshots(), t.posts(), t.ownership(), t.runs())


#: The tables with rows that break each kind of rule.
FAULTY = """f_clients as (select * from clients union all select client_id, null from clients where client_id % 10 = 3),
    f_accounts as (select account_id, platform_handle, case when account_id % 97 = 0 then 99 else provider_id end provider_id from accounts union all select account_id + 1000000000, platform_handle, provider_id from accounts where account_id % 50 = 1),
    f_ownership as (select * from ownership union all select account_id, client_id + 20, valid_to, case when account_id % 2 = 0 then valid_from end from ownership where account_id % 31 = 0 and valid_to is not null),
    f_posts as (select post_id, account_id, case when post_id % 17 = 0 then 'twin' else platform_post_id end platform_post_id, provider_id from posts where post_id % 11 <> 0),
    f_runs as (select run_id, case when run_id % 3 = 0 then null else provider_id end provider_id, started_at, case when run_id % 5 = 0 then 'done' else status end status from runs),
    f_counts as (select run_id, account_id from run_accounts union all select run_id, account_id * 2 from run_accounts where account_id % 40 = 0),
    f_snapshots as (select post_id, run_id + case when post_id % 29 = 0 then 7 else 0 end run_id, scraped_at, views - 2000 views, likes, comments, case when shares > 90 then null else shares end shares from run_snapshots)"""
_NAMED = {"clients": "f_clients", "providers": "platforms", "accounts": "f_accounts", "ownership": "f_ownership", "posts": "f_posts", "runs": "f_runs", "run_accounts": "f_counts", "snapshots": "f_snapshots"}
_LACKS = [("clients", "client_id name"), ("providers", "provider_id name"), ("accounts", "account_id platform_handle provider_id"), ("ownership", "account_id client_id valid_from"), ("posts", "post_id account_id platform_post_id provider_id"), ("runs", "run_id provider_id started_at status"), ("run_accounts", "run_id account_id"), ("snapshots", "post_id run_id scraped_at views likes comments shares")]
_TWICE = [("client_key", "clients", "client_id"), ("provider_key", "providers", "provider_id"), ("provider_name", "providers", "name"), ("account_key", "accounts", "account_id"), ("handle_of_provider", "accounts", "platform_handle, provider_id"), ("one_open_owner", "ownership", "account_id"), ("post_key", "posts", "post_id"), ("post_of_provider", "posts", "platform_post_id, provider_id"), ("run_key", "runs", "run_id"), ("account_of_run", "run_accounts", "run_id, account_id")]
_LOST = [("account_provider", "accounts", "provider_id", "providers"), ("owned_account", "ownership", "account_id", "accounts"), ("owning_client", "ownership", "client_id", "clients"), ("post_account", "posts", "account_id", "accounts"), ("post_provider", "posts", "provider_id", "providers"), ("run_provider", "runs", "provider_id", "providers"), ("counted_run", "run_accounts", "run_id", "runs"), ("counted_account", "run_accounts", "account_id", "accounts"), ("snapshot_post", "snapshots", "post_id", "posts"), ("snapshot_run", "snapshots", "run_id", "runs")]
_COUNTS = [f"select '{t}.{c}' rule, count(*) n from {_NAMED[t]} where \"{c}\" is null" for t, columns in _LACKS for c in columns.split()]
_COUNTS += [f"select '{rule}', count(*) from (select 1 from {_NAMED[t]} where {' is not null and '.join(key.split(', '))} is not null{' and valid_to is null' if t == 'ownership' else ''} group by {key} having count(*) > 1)" for rule, t, key in _TWICE]
_COUNTS += [f"select '{rule}', count(*) from {_NAMED[t]} c where c.{key} is not null and not exists (select 1 from {_NAMED[to]} p where p.{key} = c.{key})" for rule, t, key, to in _LOST]
_COUNTS += [f"select '{m}_not_negative', count(*) from f_snapshots where {m} < 0" for m in metrics.METRICS]
_COUNTS += ["select 'period_forward', count(*) from f_ownership where valid_to <= valid_from", "select 'run_status', count(*) from f_runs where status not in ('running', 'completed', 'failed', 'partial')"]


@query(f"with {FAULTY} " + " union all ".join(_COUNTS))
def schema_violations(t: Tables) -> DataFrame:
    col, mod = F.col, lambda c, n: F.pmod(c, F.lit(n))
    clients, accounts, held, posts, run = t.clients(), t.accounts(), t.ownership(), t.posts(), t.runs()
    counts = t.run_accounts().select("run_id", "account_id")
    return constraints.violations({
        "clients": clients.unionByName(clients.where(mod("client_id", 10) == 3).withColumn("name", F.lit(None).cast("string"))), "providers": t.platforms(),
        "accounts": accounts.withColumn("provider_id", F.when(mod("account_id", 97) == 0, 99).otherwise(col("provider_id"))).unionByName(accounts.where(mod("account_id", 50) == 1).withColumn("account_id", col("account_id") + 1000000000)),
        "ownership": held.unionByName(held.where((mod("account_id", 31) == 0) & col("valid_to").isNotNull()).select("account_id", (col("client_id") + 20).alias("client_id"), col("valid_to").alias("valid_from"), F.when(mod("account_id", 2) == 0, col("valid_from")).alias("valid_to"))),
        "posts": posts.where(mod("post_id", 11) != 0).repartition(t.parts(), "post_id").withColumn("platform_post_id", F.when(mod("post_id", 17) == 0, "twin").otherwise(col("platform_post_id"))),
        "runs": run.withColumn("provider_id", F.when(mod("run_id", 3) != 0, col("provider_id"))).withColumn("status", F.when(mod("run_id", 5) == 0, "done").otherwise(col("status"))),
        "run_accounts": counts.unionByName(counts.where(mod("account_id", 40) == 0).withColumn("account_id", col("account_id") * 2)),
        "snapshots": t.run_snapshots().withColumn("run_id", col("run_id") + F.when(mod("post_id", 29) == 0, 7).otherwise(0)).withColumn("views", col("views") - 2000).withColumn("shares", F.when(col("shares") <= 90, col("shares"))),
    })


# --- recorded devices and screens: made from the customer table -----------------------------------


@query("""select cast(c_custkey as varchar) device_id, 'sim_mcc' \"check\", case when c_custkey % 4 = 0 then 0 when 300 + c_custkey % 30 between 310 and 316 then 0 else 1 end failures, case when c_custkey % 4 = 0 then 1 else 0 end warnings,
    case when c_custkey % 4 = 0 then 'warn' when 300 + c_custkey % 30 between 310 and 316 then 'pass' else 'fail' end status, c_custkey % 4 = 0 or 300 + c_custkey % 30 between 310 and 316 passed from customer""")
def compliance_sim(t: Tables) -> DataFrame:
    raw = F.create_map(F.lit("getprop gsm.sim.state"), F.when(F.pmod("c_custkey", F.lit(4)) == 0, "ABSENT").otherwise("READY"), F.lit("getprop gsm.sim.operator.numeric"), F.concat((F.pmod("c_custkey", F.lit(30)) + 300).cast("string"), F.lit("260")))
    lists = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))
    results = t.raw("customer").select(F.col("c_custkey").cast("string").alias("device_id"), F.lit("sim_mcc").alias("check"), raw.alias("raw"), lists.alias("lists"))
    return rules.verdicts(results).withColumns({c: F.col(c).cast("int") for c in ("failures", "warnings")})


CHECKS = ["locale", "timezone", "wifi", "ip_validation", "gps_location", "screen_lock", "usb_debugging", "app_state", "battery"]


def _checked(t: Tables) -> DataFrame:
    """Recorded checks of each customer's device: what is found depends on the customer's number."""
    k = F.col("c_custkey")
    at = lambda n, *values: F.array(*[F.lit(v) for v in values])[F.least(F.pmod(k, F.lit(n)), F.lit(len(values) - 1)).cast("int")]
    raw = {
        "getprop persist.sys.locale": at(5, "de-DE", "en_US", "en-US", ""), "getprop ro.product.locale": at(7, "de_DE", "en-us", "", "EN-US"), "getprop persist.sys.timezone": at(3, "Europe/Paris", "US/Central", ""),
        "settings get global auto_time_zone": at(4, "1", "0"), "wifi_on": at(2, "0", "1"), "public_ip": F.concat(F.pmod(k, F.lit(256)).cast("string"), F.lit(".1.2.3")), "location_mode": at(6, "3", "0"),
        "locksettings get-disabled": at(9, "TRUE", "false", "?"), "settings get secure lockscreen.password_type": at(8, "0", "131072", ""), "settings get global adb_enabled": at(3, "1", "0"),
        "settings get global development_settings_enabled": at(5, "1", "0"), "pm_list": at(10, "package:org.other", "package:com.example.app"), "version_name": F.when(F.pmod(k, F.lit(12)) != 0, F.concat(F.lit("versionName="), F.pmod(k, F.lit(110)).cast("string"), F.lit(".1"))),
        "shared_prefs": at(13, "user_session.xml\nui.xml\nauth.xml", "No such file or directory: account", "theme.xml"),
    }
    raw = F.create_map(*[x for name, v in raw.items() for x in (F.lit(name), v)])
    some = lambda n, stem: F.transform(F.slice(F.sequence(F.lit(0), F.lit(n)), 1, F.pmod(k, F.lit(n + 1)).cast("int")), lambda i: F.concat(F.lit(stem), i.cast("string")))
    lists = F.create_map(F.lit("location_grants"), some(7, "app"), F.lit("saved_networks"), some(4, "net"))
    return t.raw("customer").select(k.cast("string").alias("device_id"), F.explode(F.array(*[F.lit(c) for c in CHECKS])).alias("check"), raw.alias("raw"), lists.alias("lists"))


#: Failures and warnings of each check, by the customer's number k.
JUDGED = """props as (select k, own, ro, case when own <> '' then own else ro end effective from (select c_custkey k, ['de-DE', 'en_US', 'en-US', ''][least(c_custkey % 5, 3) + 1] own, ['de_DE', 'en-us', '', 'EN-US'][least(c_custkey % 7, 3) + 1] ro from customer)),
    judged as (
    select k, 'locale' "check", (effective = '' or lower(replace(effective, '_', '-')) <> 'en-us')::bigint failures, (own <> '' and ro <> '' and lower(replace(own, '_', '-')) <> lower(replace(ro, '_', '-')))::bigint warnings from props
    union all select c_custkey, 'timezone', (c_custkey % 3 <> 1)::bigint + (c_custkey % 4 = 0)::bigint, 0 from customer
    union all select c_custkey, 'wifi', (c_custkey % 2 = 1)::bigint + (c_custkey % 5 > 0)::bigint, 0 from customer
    union all select c_custkey, 'ip_validation', (c_custkey % 256 in (0, 10, 127) or c_custkey % 256 >= 224)::bigint, (not (c_custkey % 256 in (0, 10, 127) or c_custkey % 256 >= 224))::bigint from customer
    union all select c_custkey, 'gps_location', (c_custkey % 6 = 0)::bigint + (c_custkey % 8 > 0)::bigint, 0 from customer
    union all select c_custkey, 'screen_lock', (c_custkey % 9 = 0)::bigint + (c_custkey % 9 > 1 and c_custkey % 8 = 0)::bigint, (c_custkey % 9 > 1 and c_custkey % 8 > 1)::bigint from customer
    union all select c_custkey, 'usb_debugging', 0, (c_custkey % 3 = 0)::bigint + (c_custkey % 5 = 0)::bigint from customer
    union all select c_custkey, 'app_state', (c_custkey % 10 = 0)::bigint + (c_custkey % 10 > 0 and c_custkey % 12 <> 0 and c_custkey % 110 < 20)::bigint + case when c_custkey % 10 > 0 and c_custkey % 13 = 0 then 2 else 0 end,
        (c_custkey % 10 > 0 and c_custkey % 12 = 0)::bigint + (c_custkey % 10 > 0 and c_custkey % 12 <> 0 and c_custkey % 110 > 99)::bigint from customer
    union all select c_custkey, 'battery', 0, 1 from customer)"""


@query(f"""with {JUDGED} select cast(k as varchar) device_id, "check", failures, warnings, case when failures > 0 then 'fail' when warnings > 0 then 'warn' else 'pass' end status, sum(failures) over (partition by k) = 0 passed from judged""")
def compliance_verdict(t: Tables) -> DataFrame:
    return rules.verdicts(_checked(t))


@query(f"""with {JUDGED} select cast(k as varchar) device_id, sum(failures) = 0 passed, cast(sum(failures) as bigint) n_failures, cast(sum(warnings) as bigint) n_warnings, count(*) filter ("check" <> 'battery') n_details,
    max(case when "check" = 'wifi' then case when failures > 0 then 'fail' else 'pass' end end) wifi from judged group by k""")
def compliance_report(t: Tables) -> DataFrame:
    """The JSON reports, read back."""
    form = "struct<pass:boolean,failures:array<string>,warnings:array<string>,details:map<string,struct<failures:array<string>,warnings:array<string>,status:string>>>"
    r = rules.reports(_checked(t)).withColumn("r", F.from_json("report", form))
    return r.select("device_id", F.col("r.pass").alias("passed"), F.size("r.failures").cast("long").alias("n_failures"), F.size("r.warnings").cast("long").alias("n_warnings"), F.size("r.details").cast("long").alias("n_details"), F.col("r.details")["wifi"]["status"].alias("wifi"))


@query("""select cast(c_custkey as varchar) device_id, 'gps_location' "check", 'failure' severity, 'gps_location: ' || n || ' app(s) may read the location: ' || array_to_string([('app' || i) for i in range(least(n, 5))], ', ') message from (select c_custkey, c_custkey % 8 n from customer) where n > 0
    union all select cast(c_custkey as varchar), 'wifi', 'failure', 'wifi: ' || n || ' saved network(s): ' || array_to_string([('net' || i) for i in range(least(n, 3))], ', ') from (select c_custkey, c_custkey % 5 n from customer) where n > 0""")
def compliance_samples(t: Tables) -> DataFrame:
    """Findings that show only the first few names of a list."""
    return rules.findings(_checked(t).where(F.col("check").isin("gps_location", "wifi"))).where("message like '%: %: %'")


SIGNS = [("home_feed", 0, 0, "text", "(?i)for you"), ("profile", 1, 0, "text", "(?i)followers"), ("profile", 1, 1, "text", "(?i)^edit"), ("profile", 1, 1, "class", "Button$"), ("popup", 6, 0, "resource_id", "(?i)dialog")]


@query("select cast(c_custkey as varchar) screen, case when c_custkey % 7 = 0 then 'popup' when c_custkey % 11 = 0 then 'unknown' when c_custkey % 4 = 1 then 'profile' when c_custkey % 3 = 0 then 'home_feed' else 'profile' end state from customer")
def ui_screen_score(t: Tables) -> DataFrame:
    """Screens of two or three nodes; every eleventh dump is broken, unless a dialog shows."""
    k = lambda n: F.pmod("c_custkey", F.lit(n))
    text = F.when(k(3) == 0, "For you").otherwise("Followers")
    edit = F.when(k(4) == 1, '<node text="Edit" class="x.Button"/><node text="followers"/>').otherwise('<node text="Edit" class="x.Label"/>')
    popup = F.when(k(7) == 0, '<node resource-id="dialog"/>').otherwise('<node resource-id="list"/>')
    end = F.when((k(11) == 0) & (k(7) != 0), "</hier").otherwise("</hierarchy>")
    xml = F.concat(F.lit('<hierarchy><node text="'), text, F.lit('"/>'), edit, popup, end)
    return uilog.scored(t.raw("customer").select(F.col("c_custkey").cast("string").alias("screen"), xml.alias("xml")), SIGNS)


#: What the links of a page are named.
LINKS = [("english", "the|and|of|to"), ("german", "der|die|und|das"), ("french", "le|la|de|et"), ("spanish", "el|que|y|los")]


@query("select page_id page, tag, count(*) n from (select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) tag from pages) group by all")
def page_elements(t: Tables) -> DataFrame:
    """Elements of every page by the table function, in SQL."""
    markup.register(t.spark)
    return t.spark.sql("select page, tag, count(*) n from page_elements(table(select page_id page, html from {pages}) partition by page) group by page, tag", pages=t.raw("pages"))


@query("with n as (select page_id page, unnest([" + ", ".join(f"{{'state': '{state}', 'rank': {i}, 'votes': len(regexp_extract_all(html, 'href=\"/(?:{words})\"'))}}" for i, (state, words) in enumerate(LINKS)) + """]) v from pages)
    select page, case when max(v.votes) > 0 then arg_min(v.state, -v.votes * 10 + v.rank) else 'unknown' end state, cast(max(v.votes) as bigint) votes from n group by page""")
def page_states(t: Tables) -> DataFrame:
    """The language that most links of a page speak for."""
    return markup.page_states(t.raw("pages").withColumnRenamed("page_id", "page"), [(state, "href", f"^/(?:{words})$") for state, words in LINKS])


@query("""select cast(c_custkey as varchar) screen, ((c_custkey % 500) + 600) / 2.0 / 1080 x, ((c_custkey % 700) + 1400) / 2.0 / case when c_custkey % 3 = 0 then 2400 else 1920 end y from customer where c_custkey % 9 <> 0""")
def element_places(t: Tables) -> DataFrame:
    """Where the button that says save is; every ninth screen has none with bounds."""
    k = F.col("c_custkey")
    node = lambda text, bounds: F.concat(F.lit(f'<node text="{text}" bounds="'), bounds, F.lit('"/>'))
    box = F.concat(F.lit("["), F.pmod(k, F.lit(500)).cast("string"), F.lit(","), F.pmod(k, F.lit(700)).cast("string"), F.lit("][600,1400]"))
    dump = F.concat(F.lit("<hierarchy>"), node("Save", F.lit("none")), node("Cancel", F.lit("[0,0][2,2]")), F.when(F.pmod(k, F.lit(9)) != 0, node("SAVE it", box)).otherwise(""), node("save later", F.when(F.pmod(k, F.lit(9)) != 0, "[1,1][3,3]").otherwise("")), F.lit("</hierarchy>"))
    screens = t.raw("customer").select(k.cast("string").alias("screen"), dump.alias("xml"), F.when(F.pmod(k, F.lit(3)) == 0, 2400).otherwise(1920).alias("h"))
    return markup.element_places(screens, "text", "save", F.lit(1080), F.col("h"))


# --- device text -----------------------------------------------------------------------------------


@query("""select event_id, epoch_us(ts) - case event_id % 3 when 1 then 19800000000 else 0 end at_micros from events""")
def parsed_times(t: Tables) -> DataFrame:
    """Times written with Z, with an offset, and without either."""
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.pmod("event_id", F.lit(3)) == 0, "Z").when(F.pmod("event_id", F.lit(3)) == 1, "+05:30").otherwise(""))
    return t.raw("events").select("event_id", F.unix_micros(X.parsed_time(written)).alias("at_micros"))


@query("""with parts as (select event_id, [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 93, 255][event_id % 13 + 1] a, [0, 64, 254, 16, 168, 18, 51, 31, 200, 256][event_id // 13 % 10 + 1] b, [0, 2, 100, 113, 7][event_id // 130 % 5 + 1] c, [9, 10, 1, 255][event_id // 650 % 4 + 1] d from events)
    select event_id, b < 256 and (a || '.' || b || '.' || c || '.' || d in ('192.0.0.9', '192.0.0.10') or not (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31)
    or (a = 192 and b = 0 and c in (0, 2)) or (a = 192 and b = 168) or (a = 198 and b in (18, 19)) or (a = 198 and b = 51 and c = 100) or (a = 203 and b = 0 and c = 113))) "public" from parts""")
def public_addresses(t: Tables) -> DataFrame:
    pick = lambda every, *values: F.array(*[F.lit(str(v)) for v in values])[F.pmod(F.floor(F.col("event_id") / every), F.lit(len(values))).cast("int")]
    address = F.concat_ws(".", pick(1, 0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 8, 93, 255), pick(13, 0, 64, 254, 16, 168, 18, 51, 31, 200, 256), pick(130, 0, 2, 100, 113, 7), pick(650, 9, 10, 1, 255))
    return t.raw("events").select("event_id", X.is_public_ipv4(address).alias("public"))


@query("""select c_custkey, lower(replace(case c_custkey % 3 when 0 then 'en_US' when 1 then 'De-AT' else 'fr' end, '_', '-')) locale, case when c_custkey % 2 = 0 then 'uid ' || c_custkey || ': COARSE_LOCATION: allow' else '' end grants,
    case when c_custkey % 4 = 0 then 'NetworkId 1 SSID home' || c_custkey else '' end networks, ((c_custkey % 500) + 600) / 2.0 / 1000 centre_x, ((c_custkey % 700) + 1400) / 2.0 / 2000 centre_y,
    cast(floor((c_custkey % 100) / 100.0 * 1080) as integer) pixel, cast(1080 + c_custkey % 5 as integer) width, case when c_custkey % 2 = 0 then 2400 else 2300 end height from customer""")
def device_text(t: Tables) -> DataFrame:
    """Locales, grants, saved networks, bounds, pixels and screen sizes as devices print them."""
    k, n = F.col("c_custkey"), lambda m: F.pmod("c_custkey", F.lit(m))
    number = k.cast("string")
    locale = F.when(n(3) == 0, "en_US").when(n(3) == 1, "De-AT").otherwise("fr")
    ops = F.concat(F.lit("uid "), number, F.when(n(2) == 0, ": COARSE_LOCATION: allow").otherwise(": COARSE_LOCATION: deny"), F.lit("\nCAMERA: allow\nother"))
    saved = F.concat(F.when(n(4) == 0, F.concat(F.lit("NetworkId 1 SSID home"), number)).otherwise("none"), F.lit("\nend"))
    bounds = F.concat(F.lit("["), n(500).cast("string"), F.lit(","), n(700).cast("string"), F.lit("][600,1400]"))
    size = F.concat(F.lit("Override size: 1080x2300\n"), F.when(n(2) == 0, F.concat(F.lit("Physical size: "), (n(5) + 1080).cast("string"), F.lit("x2400"))).otherwise(""))
    first = F.concat((n(5) + 1080).cast("string"), F.lit("x2300 720x1280"))
    shown = X.screen_size(F.when(n(2) == 0, size).otherwise(first))
    centre = X.bounds_centre(bounds, F.lit(1000), F.lit(2000))
    return t.raw("customer").select(
        "c_custkey", X.locale_key(locale).alias("locale"), F.array_join(X.lines_with(ops, "LOCATION", "allow"), "|").alias("grants"), F.array_join(X.lines_with(saved, "SSID"), "|").alias("networks"),
        centre["x"].alias("centre_x"), centre["y"].alias("centre_y"), X.pixel(n(100) / 100, F.lit(1080)).alias("pixel"), shown["width"].alias("width"), shown["height"].alias("height"),
    )


# --- the store --------------------------------------------------------------------------------------


@query("select p.post_id, p.platform_post_id, p.provider_id from posts p where p.post_id % 3 <> 0 or p.post_id % 2 = 1")
def conditional_insert(t: Tables) -> DataFrame:
    """Posts to add where the store has every third of them, and an offered post comes twice."""
    p = t.posts()
    had = p.where("post_id % 3 = 0 and post_id % 2 = 0").select("platform_post_id", "provider_id")
    return store.new_posts(p.unionByName(p), had).select("post_id", "platform_post_id", "provider_id")


@query("""with events_of as (select run_id, started_at "at", 'running' status from runs union all select run_id, started_at + interval 1 hour, status from runs where run_id % 3 <> 0)
    select run_id, arg_max(status, "at") status from events_of group by run_id""")
def run_states(t: Tables) -> DataFrame:
    """The latest of appended events stands for an update."""
    r = t.runs()
    later = r.where("run_id % 3 <> 0").select("run_id", (F.col("started_at") + F.make_dt_interval(hours=F.lit(1))).alias("at"), "status")
    return store.latest_status(r.select("run_id", F.col("started_at").alias("at"), F.lit("running").alias("status")).unionByName(later))


@query("select p.account_id, c.client_id, p.n posts from (select account_id, count(*) n from posts group by account_id) p join (select account_id, case when account_id = 7 then 3 else client_id end client_id from ownership where valid_to is null) c using (account_id)")
def owners_after_move(t: Tables) -> DataFrame:
    """Open owners after account 7 moved to client 3, with the account's posts."""
    moved = store.close_and_open(t.ownership(), 7, 3, "1999-01-01 00:00:00").where("valid_to is null").select("account_id", "client_id")
    return t.posts().groupBy("account_id").agg(F.count("*").alias("posts")).join(moved, "account_id").select("account_id", "client_id", "posts")
