"""High-water marks, attribution by ownership interval, regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.asof import holding

METRICS = ("views", "likes", "comments", "shares")


def high_water(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("post_id").agg(*[F.max(m).alias(f"max_{m}") for m in METRICS])


def merged_high_water(old: DataFrame, new: DataFrame) -> DataFrame:
    """Marks after more snapshots; old marks and the new snapshots' marks only."""
    return old.unionByName(high_water(new)).groupBy("post_id").agg(*[F.max(f"max_{m}").alias(f"max_{m}") for m in METRICS])


def owned(posts: DataFrame, ownership: DataFrame) -> DataFrame:
    """Posts with client_id, each owner of the account when they were published; [valid_from, valid_to).

    A post without a time, or in a gap, drops out.  See ``asof.holding`` for the join.
    """
    return holding(posts, ownership.select("account_id", "client_id", "valid_from", "valid_to"), "account_id", "published_at")


def first_owner(posts: DataFrame, assignments: DataFrame, key: str = "post_id", default: str = "unattributed") -> DataFrame:
    """Posts with the first assignment in input order that covers them, else the default."""
    a = assignments.select("account_id", "client", "valid_from", "valid_to", F.col("ord").alias("turn"))
    joined = holding(posts.select(key, "account_id", "published_at"), a, "account_id", "published_at", "left")
    return joined.groupBy(key).agg(F.coalesce(F.min_by("client", "turn"), F.lit(default)).alias("client"))


def client_totals(snapshots: DataFrame, posts: DataFrame, ownership: DataFrame, clients: DataFrame) -> DataFrame:
    per_post = high_water(snapshots).select("post_id", "max_views")
    held = owned(posts.select("post_id", "account_id", "published_at"), ownership).select("post_id", "client_id")
    totals = per_post.join(held, "post_id").groupBy("client_id").agg(F.sum("max_views").cast("long").alias("total_high_water_views"))
    return totals.join(clients.select("client_id", F.col("name").alias("client_name")), "client_id").select("client_id", "client_name", "total_high_water_views")


def client_total(snapshots: DataFrame, posts: DataFrame, ownership: DataFrame, clients: DataFrame, name: str) -> DataFrame:
    return client_totals(snapshots, posts, ownership, clients.where(F.col("name") == name)).select("client_name", "total_high_water_views")


def client_posts(snapshots: DataFrame, posts: DataFrame, ownership: DataFrame, clients: DataFrame, name: str) -> DataFrame:
    per_post = high_water(snapshots).select("post_id", "max_views")
    one = clients.where(F.col("name") == name).select("client_id")
    held = owned(posts.select("post_id", "account_id", "published_at"), ownership).join(one, "client_id", "left_semi").select("post_id")
    return per_post.join(held, "post_id")


def attribution(snapshots: DataFrame, posts: DataFrame, ownership: DataFrame, clients: DataFrame, client_id: int) -> DataFrame:
    """Posts of accounts that a client owns now, by their owner at publication."""
    now = ownership.where((F.col("client_id") == client_id) & F.col("valid_to").isNull()).select("account_id")
    mine = posts.select("post_id", "account_id", "published_at").join(now, "account_id")
    held = owned(mine, ownership).join(high_water(snapshots).select("post_id", "max_views"), "post_id")
    totals = held.groupBy("client_id").agg(F.countDistinct("post_id").alias("post_count"), F.sum("max_views").cast("long").alias("total_views"))
    return totals.join(clients, "client_id").select(F.col("name").alias("owning_client_at_publish"), "post_count", "total_views")


ATTRIBUTION = """
    with marks as (select post_id, max(views) max_views from {snapshots} group by post_id),
    now as (select account_id from {ownership} where client_id = :client and valid_to is null)
    select c.name owning_client_at_publish, count(distinct p.post_id) post_count, cast(sum(max_views) as bigint) total_views
    from {posts} p join now using (account_id) join {ownership} o on o.account_id = p.account_id and p.published_at >= o.valid_from and (p.published_at < o.valid_to or o.valid_to is null)
    join {clients} c on c.client_id = o.client_id join marks on marks.post_id = p.post_id group by c.client_id, c.name
"""


def attribution_prepared(snapshots: DataFrame, posts: DataFrame, ownership: DataFrame, clients: DataFrame, client_id: int) -> DataFrame:
    """As ``attribution``, as a SQL statement with a bound parameter; the value never becomes part of the text."""
    return snapshots.sparkSession.sql(ATTRIBUTION, args={"client": client_id}, snapshots=snapshots, posts=posts, ownership=ownership, clients=clients)


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """Last snapshot of each post; ties go to the greatest ``turn``. One aggregation, no sort."""
    last = snapshots.groupBy("post_id").agg(F.max_by(F.struct("scraped_at", *METRICS), F.struct("scraped_at", "turn")).alias("s"))
    return last.select("post_id", "s.*")


def regressions(snapshots: DataFrame, posts: DataFrame) -> DataFrame:
    both = snapshots.groupBy("post_id").agg(
        F.max_by(F.struct("scraped_at", *METRICS), F.struct("scraped_at", "turn")).alias("last"), *[F.max(m).alias(f"max_{m}") for m in METRICS]
    )  # marks and last snapshot share the scan and the shuffle
    worse = F.lit(False)
    for m in METRICS:
        worse = worse | (F.col(f"last.{m}") < F.col(f"max_{m}"))
    named = both.where(worse).join(posts.select("post_id", "platform_post_id"), "post_id")
    return named.select(
        "post_id", "platform_post_id", F.col("last.views").alias("latest_views"), F.col("max_views").alias("highest_views"), F.col("last.likes").alias("latest_likes"), F.col("max_likes").alias("highest_likes"),
        F.col("last.comments").alias("latest_comments"), F.col("max_comments").alias("highest_comments"), F.col("last.scraped_at").alias("latest_scrape_time"),
    )


def ranked_by_views(snapshots: DataFrame, top: int) -> DataFrame:
    """Posts of the highest marks; a top-k report."""
    return high_water(snapshots).select("post_id", "max_views").orderBy(F.desc("max_views"), "post_id").limit(top)


