"""Domain tables over the star-schema test tables, as DataFrames and as SQL for the checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPLIT = "1998-01-01"
START = "1995-01-01"
#: Snapshots that one task joins with their posts, or sums by account.
TASK_ROWS = 250_000


class Tables:
    """Lazily read domain tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._parts = 0

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def clients(self) -> DataFrame:
        return self.raw("nation").select(F.col("n_nationkey").cast("long").alias("client_id"), F.col("n_name").alias("name"))

    def platforms(self) -> DataFrame:
        return self.raw("region").select(F.col("r_regionkey").cast("long").alias("provider_id"), F.col("r_name").alias("name"))

    def accounts(self) -> DataFrame:
        nation = self.raw("nation").select("n_nationkey", "n_regionkey")
        own = self.raw("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return own.select(F.col("c_custkey").cast("long").alias("account_id"), F.col("c_name").alias("platform_handle"), F.col("n_regionkey").cast("long").alias("provider_id"))

    def ownership(self) -> DataFrame:
        split, start = F.lit(SPLIT).cast("timestamp_ntz"), F.lit(START).cast("timestamp_ntz")
        none = F.lit(None).cast("timestamp_ntz")
        first = F.struct(F.col("c_nationkey").cast("long").alias("client_id"), start.alias("valid_from"), split.alias("valid_to"))
        then = F.struct(F.pmod(F.col("c_nationkey") + 1, F.lit(25)).cast("long").alias("client_id"), split.alias("valid_from"), none.alias("valid_to"))
        return self.raw("customer").select(F.col("c_custkey").cast("long").alias("account_id"), F.inline(F.array(first, then)))

    def posts(self) -> DataFrame:
        orders = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        own = orders.join(self.accounts(), F.col("o_custkey") == F.col("account_id"))
        return own.select(F.col("o_orderkey").cast("long").alias("post_id"), "account_id", F.col("o_orderkey").cast("string").alias("platform_post_id"), "provider_id", F.col("o_orderdate").cast("timestamp_ntz").alias("published_at"))

    def snapshots(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.col("l_orderkey").cast("long").alias("post_id"), F.col("l_shipdate").cast("timestamp_ntz").alias("scraped_at"),
            F.floor("l_extendedprice").cast("long").alias("views"), F.floor("l_quantity").cast("long").alias("likes"),
            F.col("l_linenumber").cast("long").alias("comments"), F.pmod(F.col("l_partkey"), F.lit(100)).cast("long").alias("shares"),
            F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("turn"),
        )

    def parts(self) -> int:
        """Tasks for what is dealt by post or account: their number grows with the snapshots (counted by the files' footers), not their memory."""
        self._parts = self._parts or max(1, math.ceil(self.raw("lineitem").count() / TASK_ROWS))
        return self._parts

    def run_snapshots(self) -> DataFrame:
        """Snapshots with their run, platform and account."""
        posts = self.posts().select("post_id", "account_id", "provider_id").repartition(self.parts(), "post_id")
        run = F.col("provider_id") * 1000000 + F.year("scraped_at") * 100 + F.month("scraped_at")
        return self.snapshots().repartition(self.parts(), "post_id").join(posts, "post_id").withColumn("run_id", run)

    def runs(self) -> DataFrame:
        return self.run_snapshots().select("run_id", "provider_id", F.date_trunc("month", "scraped_at").cast("timestamp_ntz").alias("started_at")).distinct().withColumn("status", run_status())

    def run_accounts(self) -> DataFrame:
        """posts_found and posts_expected by (run, account); expected counts posts published before the run's month ends."""
        month = lambda c: F.date_trunc("month", c).alias("month")
        # a post of a run is one row by now; both kinds of rows go to their account at once, where the groups and their sums are made
        found = self.run_snapshots().select("account_id", "run_id", month("scraped_at"), "post_id").distinct().select("account_id", "run_id", "month", F.lit(1).alias("found"), F.lit(0).alias("n"))
        there = self.posts().select("account_id", F.lit(None).cast("long").alias("run_id"), month("published_at"), F.lit(0).alias("found"), F.lit(1).alias("n"))
        both = found.unionByName(there).repartition(self.parts(), "account_id").groupBy("account_id", "month", "run_id").agg(F.sum("found").alias("posts_found"), F.sum("n").alias("n"))
        so_far = F.sum("n").over(W.partitionBy("account_id").orderBy("month").rangeBetween(W.unboundedPreceding, 0))
        return both.withColumn("posts_expected", so_far).where("run_id is not null").select("run_id", "account_id", "posts_expected", "posts_found")

    def jobs(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").cast("long").alias("account_id"), F.col("event_id").cast("long").alias("ord"), (F.col("event_type") == "error").alias("failed"))

    def vendor_posts(self) -> DataFrame:
        """Both vendors' posts: vendor, ord, id, url, views, likes, comments, caption, posted_at, account.

        Some of A's rows are share links (some of them listed twice, some under one link), unknown
        links with and without an id, or links whose id isn't the row's own.
        """
        d = self.raw("documents").select("doc_id", "text", "source", "n_chars")
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 1200).cast("timestamp_ntz")
        link = lambda i: F.concat(F.lit("https://www.tiktok.com/@"), F.col("source"), F.lit("/video/"), i.cast("string"))
        nth = lambda k, r: F.pmod("doc_id", F.lit(k)) == r
        number, share = F.col("doc_id").cast("string"), nth(10, 0)
        base = [F.lit(0).cast("long").alias("likes"), F.lit(0).cast("long").alias("comments")]
        other = F.concat(F.lit("https://other.example/p"), number)
        url = F.when(share & nth(40, 20) | nth(40, 7), other).when(share & nth(70, 0), "https://vm.tiktok.com/Zsame").when(share, F.concat(F.lit("https://vm.tiktok.com/Z"), number)).otherwise(link(F.col("doc_id")))
        own = F.when(~share, F.when(nth(100, 63), F.col("doc_id") + F.lit(7000000000)).otherwise(F.col("doc_id")).cast("string"))
        twice = F.explode(F.when(nth(30, 10), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        a = d.withColumn("twin", twice).select(F.lit("A").alias("vendor"), (F.col("doc_id") + F.col("twin") * F.lit(2000000000).cast("long")).alias("ord"), own.alias("id"), url.alias("url"), F.col("n_chars").alias("views"), *base, F.col("text").alias("caption"), at.alias("posted_at"), F.concat(F.lit("@"), F.col("source")).alias("account"))
        short = F.when(F.length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("..."))).otherwise(F.col("text"))
        b = d.where(~nth(30, 0)).withColumn("twin", F.explode(F.when(nth(20, 0), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        n = F.col("doc_id") + F.col("twin") * F.lit(1000000000).cast("long")
        b = b.select(F.lit("B").alias("vendor"), n.alias("ord"), n.cast("string").alias("id"), link(n).alias("url"), (F.col("n_chars") - F.pmod("doc_id", F.lit(5))).alias("views"), *base, short.alias("caption"), at.alias("posted_at"), F.concat(F.lit("@"), F.col("source")).alias("account"))
        return a.unionByName(b)

    def syndicated_posts(self) -> DataFrame:
        """The vendors' posts, all of them listed again later under one account, so that ids are reached from two."""
        p = self.vendor_posts()
        return p.unionByName(p.withColumn("ord", F.col("ord") + F.lit(4000000000).cast("long")).withColumn("account", F.lit("@again")))

    def previous_posts(self) -> DataFrame:
        """The last snapshot: ord, id, views, likes, scraped_at, source; some ids twice, some no vendor lists."""
        d = self.raw("documents").select("doc_id", "n_chars").where(F.pmod("doc_id", F.lit(4)) == 3)
        twin = F.explode(F.when(F.pmod("doc_id", F.lit(200)) == 107, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        gone = F.when(F.pmod("doc_id", F.lit(100)) == 7, F.col("doc_id") + F.lit(5000000000)).otherwise(F.col("doc_id"))
        views = F.col("n_chars") + F.pmod("doc_id", F.lit(3)) - 1 + 5 * F.col("twin")
        return d.withColumn("twin", twin).select(
            (F.col("doc_id") + F.col("twin") * F.lit(1000000000).cast("long")).alias("ord"), gone.cast("string").alias("id"), views.alias("views"), F.lit(0).cast("long").alias("likes"),
            F.lit("2023-12-31").cast("timestamp_ntz").alias("scraped_at"), F.lit("A").alias("source"),
        )

    def assignments(self) -> DataFrame:
        """Owners of the vendors' accounts: account, ord, client, valid_from, valid_to; one account has none."""
        time = lambda s: F.lit(s).cast("timestamp_ntz")
        periods = F.array(
            F.struct(F.lit("client_a").alias("client"), time("2023-01-01").alias("valid_from"), time("2024-01-05").alias("valid_to")),
            F.struct(F.lit("client_b").alias("client"), time("2024-01-05").alias("valid_from"), time(None).alias("valid_to")),
        )
        rows = self.raw("documents").where("source <> 'src3'").select("source").distinct()
        return rows.select(F.concat(F.lit("@"), F.col("source")).alias("account"), F.posexplode(periods).alias("ord", "p")).select("account", F.col("ord").cast("long").alias("ord"), "p.*")

    def devices(self) -> DataFrame:
        return self.raw("customer").select(
            F.col("c_custkey").cast("long").alias("device_id"), (F.lit(8) + F.pmod("c_custkey", F.lit(4))).cast("long").alias("version"),
            F.when(F.col("c_acctbal") < 0, "offline").otherwise("good").alias("connection"), F.when(F.pmod("c_custkey", F.lit(13)) == 0, "busy").alias("task"),
        )

    def states(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").cast("long").alias("session"), F.col("event_id").cast("long").alias("ord"), F.col("event_type").alias("state"))


def run_status():
    left = F.pmod("run_id", F.lit(7))
    return F.when(left == 0, "failed").when(left == 1, "partial").otherwise("completed")


#: The same tables in SQL; each may use those before it.
SQL = {
    "clients": "select cast(n_nationkey as bigint) client_id, n_name \"name\" from nation",
    "platforms": "select cast(r_regionkey as bigint) provider_id, r_name \"name\" from region",
    "accounts": "select cast(c_custkey as bigint) account_id, c_name platform_handle, cast(n_regionkey as bigint) provider_id from customer join nation on c_nationkey = n_nationkey",
    "ownership": f"""select cast(c_custkey as bigint) account_id, cast(c_nationkey as bigint) client_id, timestamp '{START}' valid_from, timestamp '{SPLIT}' valid_to from customer
        union all select c_custkey, cast((c_nationkey + 1) % 25 as bigint), timestamp '{SPLIT}', null from customer""",
    "posts": "select o_orderkey post_id, account_id, cast(o_orderkey as varchar) platform_post_id, provider_id, cast(o_orderdate as timestamp) published_at from orders join accounts on o_custkey = account_id",
    "snapshots": "select l_orderkey post_id, cast(l_shipdate as timestamp) scraped_at, cast(floor(l_extendedprice) as bigint) views, cast(floor(l_quantity) as bigint) likes, cast(l_linenumber as bigint) comments, cast(l_partkey % 100 as bigint) shares, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem",
    "run_snapshots": "select s.*, p.account_id, p.provider_id, p.provider_id * 1000000 + year(scraped_at) * 100 + month(scraped_at) run_id from snapshots s join posts p using (post_id)",
    "runs": "select distinct run_id, provider_id, cast(date_trunc('month', scraped_at) as timestamp) started_at, case run_id % 7 when 0 then 'failed' when 1 then 'partial' else 'completed' end status from run_snapshots",
    "run_accounts": """select f.run_id, f.account_id, f.posts_found, (select count(*) from posts p where p.account_id = f.account_id and p.published_at < f.m + interval 1 month) posts_expected
        from (select run_id, account_id, date_trunc('month', scraped_at) m, count(distinct post_id) posts_found from run_snapshots group by all) f""",
    "hwm": "select post_id, max(views) max_views, max(likes) max_likes, max(comments) max_comments, max(shares) max_shares from snapshots group by post_id",
    "jobs": "select user_id account_id, event_id ord, event_type = 'error' failed from events",
    "vendor_posts": """select 'A' vendor, doc_id + 2000000000 * twin ord, case when doc_id % 10 <> 0 then cast(case when doc_id % 100 = 63 then doc_id + 7000000000 else doc_id end as varchar) end id,
            case when doc_id % 40 in (20, 7) then 'https://other.example/p' || doc_id when doc_id % 70 = 0 then 'https://vm.tiktok.com/Zsame' when doc_id % 10 = 0 then 'https://vm.tiktok.com/Z' || doc_id
            else 'https://www.tiktok.com/@' || source || '/video/' || doc_id end url,
            n_chars views, 0::bigint likes, 0::bigint comments, text caption, timestamp '2024-01-01' + to_minutes(20 * doc_id) posted_at, '@' || source account from documents cross join (values (0), (1)) t(twin) where twin = 0 or doc_id % 30 = 10
        union all select 'B', n, cast(n as varchar), 'https://www.tiktok.com/@' || source || '/video/' || n, n_chars - doc_id % 5, 0, 0, case when length(text) > 60 then text[:60] || '...' else text end,
            timestamp '2024-01-01' + to_minutes(20 * doc_id), '@' || source
        from (select *, doc_id + twin * 1000000000 n from documents cross join (values (0), (1)) t(twin) where doc_id % 30 <> 0 and (twin = 0 or doc_id % 20 = 0))""",
    "previous_posts": """select doc_id + 1000000000 * twin ord, cast(case when doc_id % 100 = 7 then doc_id + 5000000000 else doc_id end as varchar) id, n_chars + doc_id % 3 - 1 + 5 * twin views, 0::bigint likes, timestamp '2023-12-31' scraped_at, 'A' source
        from documents cross join (values (0), (1)) t(twin) where doc_id % 4 = 3 and (twin = 0 or doc_id % 200 = 107)""",
    "assignments": """select '@' || source account, ord, client, valid_from, valid_to from (select distinct source from documents where source <> 'src3')
        cross join (values (0, 'client_a', timestamp '2023-01-01', timestamp '2024-01-05'), (1, 'client_b', timestamp '2024-01-05', null)) t(ord, client, valid_from, valid_to)""",
    "named_posts": r"""select *, nullif(regexp_extract(url, '(?i)(?:https?://)?(?:www\.)?tiktok\.com/@[\w.]+/video/(\d+)', 1), '') vid, (vendor = 'B')::bigint * 10000000000000 + ord turn, regexp_replace(caption, '\s+$', '') bare,
        case when regexp_matches(url, '(?i)(?:https?://)?(?:www\.)?tiktok\.com/@[\w.]+/video/(\d+)') then 'canonical' when regexp_matches(trim(url), '(?i)^(?:https?://)?(?:vm|vt)\.tiktok\.com/\w+/?') then 'share' else 'unknown' end kind from vendor_posts""",
    "classified": """select *, nullif(coalesce(id, case when kind = 'canonical' then vid end), '') given, kind = 'share' or (kind = 'unknown' and nullif(id, '') is null) shared, ends_with(bare, '...') cut from named_posts""",
    "within_reach": """select s.account, s.vendor share_vendor, s.ord share_ord, s.turn share_turn, c.vendor, c.ord candidate_ord, c.given candidate from classified s join classified c
        on s.account = c.account and s.shared and c.kind = 'canonical' and c.given is not null and abs(epoch_us(s.posted_at) - epoch_us(c.posted_at)) <= 3600000000
        and (s.bare = c.bare or case when s.cut and c.cut then s.bare[:-4] = c.bare[:-4] when s.cut then starts_with(c.bare, s.bare[:length(s.bare) - 3]) when c.cut then starts_with(s.bare, c.bare[:length(c.bare) - 3]) else false end)""",
    "syndicated_posts": "select * from vendor_posts union all select * replace (ord + 4000000000 as ord, '@again' as account) from vendor_posts",
    "devices": "select c_custkey device_id, 8 + c_custkey % 4 \"version\", case when c_acctbal < 0 then 'offline' else 'good' end \"connection\", case when c_custkey % 13 = 0 then 'busy' end task from customer",
    "states": "select user_id \"session\", event_id ord, event_type state from events",
}

for _name, _of in (("named_posts", "vendor_posts"), ("classified", "named_posts"), ("within_reach", "classified")):
    SQL[f"syndicated_{_name}"] = SQL[_name].replace(_of, "syndicated_posts" if _of == "vendor_posts" else f"syndicated_{_of}")


def sql(body: str) -> str:
    """A query text preceded by the domain tables that it names."""
    import re

    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, made in SQL.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(made)
    parts = [f"{n} as ({SQL[n]})" for n in SQL if n in need]
    body = body.strip()
    for head in ("with recursive ", "with "):
        if body.lower().startswith(head):
            return head + ",\n".join([*parts, body[len(head):]]) if parts else body
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body
